"""Constants that must equal the reference's for the
results to match.  Everything here is stated once; modules import it."""

# --- Fixed values (text rules) -----------------------------------------------
# Python's whitespace set (29 code points) as one character class read the
# same way by Java regex and RE2: TAB..CR, FS..SPACE, NEL, NBSP, OGHAM SPACE
# MARK, EN QUAD..HAIR SPACE, LINE SEP, PARAGRAPH SEP, NNBSP, MMSP, IDEOGRAPHIC
# SPACE.
WS_CLASS = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# URL placeholder: "URL_" followed by Unicode decimal digits.
URL_TOKEN = r"URL_\p{Nd}+"
# Word token: a run of two or more word characters (letters, numbers, "_").
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"
# Source name of the human class when binarising.
HUMAN_LABEL = "human"
# Minimum cleaned length in code points: Q&A corpus, multi-class corpus.
MIN_CHARS_QA = 20
MIN_CHARS_MULTICLASS = 50
# Domain list of the Q&A corpus.
QA_DOMAINS = ("reddit_eli5", "open_qa", "finance", "medicine", "wiki_csai")

# --- Fixed values (splits) ---------------------------------------------------
TEST_SIZE = 0.2
SEED = 42
VAL_RATIO = 0.1
RANDOM_VAL_FRACTION = 0.2

# --- Fixed values (features) -------------------------------------------------
MAX_FEATURES = 50_000
TFIDF_NGRAM_RANGE = (1, 2)
WORD_NGRAM_RANGE = (1, 3)
CHAR_WB_NGRAM_RANGE = (2, 4)
MIN_DF = 2
MAX_DF = 0.95
TOKEN_VECTOR_MAX_LEN = 100
MEAN_POOL_EPS = 1e-9

# --- Fixed values (models and training) --------------------------------------
LEARNING_RATE = 0.01
EPOCHS_CLASS_DEFAULT = 1000
EPOCHS_SCRIPT_DEFAULT = 10
SVM_C = 1.0
PROBABILITY_CLIP = 1e-15
HISTORY_POINTS = 200          # history every max(1, epochs // 200) epochs
EARLY_STOP_PATIENCE = 2
INITIAL_BEST_METRIC = -1.0

# --- Fixed values (figure numbers) -------------------------------------------
HISTOGRAM_BINS = 20
BOX_WHISKER_IQR = 1.5
