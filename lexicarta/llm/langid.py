"""Language identification by compression.

One raw-content zstandard dictionary per language is filled from a bounded
sample of labelled rows.  A lower-cased text is cut into chunks, every chunk is
compressed with every dictionary, and the language with the smallest total
wins; a narrow margin is flagged as rejected.

Defined cases: a null text or one without a letter is ``und`` with score 0
and rejected; ties go to the language with more training rows and are rejected;
a corpus without labelled rows gives ``und`` everywhere; empty tables give no
rows; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexicarta.llm.common import extended

UNDETERMINED = "und"
_RESULT = "doc_id bigint, lang_pred string, score double, margin double, rejected boolean"


@dataclass(frozen=True)
class LanguageModel:
    """``dictionaries``: language -> raw dictionary bytes, at most
    ``dict_bytes`` each, languages with more training rows first."""

    dictionaries: dict[str, bytes]
    chunk_bytes: int = 4096
    level: int = 6
    min_margin: float = 0.004


def fit(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", dict_bytes: int = 65_536,
        excerpt_bytes: int = 2048, chunk_bytes: int = 4096, min_margin: float = 0.004) -> LanguageModel:
    """Fill the dictionaries from a bounded sample of the ``usable`` rows.

    The sample is the documented bound: per language the ``4 * dict_bytes /
    excerpt_bytes`` distinct texts with the smallest hash, an excerpt of each,
    ``dict_bytes`` in total.  The hash threshold comes from the number of
    distinct text hashes, so copies thin nothing.  Counting is partial-
    aggregated and only rows under the threshold are ranked, so no language
    lands in one task.  A language whose whole sample is under 8 bytes (the
    least that a dictionary can be) has no dictionary and is never predicted.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        (F.shiftrightunsigned(F.xxhash64(text_col), 1) / F.lit(float(1 << 63))).alias("u"))
    wanted = 4 * dict_bytes // excerpt_bytes
    hashes = rows.groupBy("lang", "u").agg(F.count("*").alias("n"))
    found = hashes.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()
    counts = {r.lang: r.n for r in found}
    if not counts:
        return LanguageModel({}, chunk_bytes, min_margin=min_margin)
    limits = F.create_map(*[F.lit(x) for r in found for x in (r.lang, min(1.0, 4.0 * wanted / r.texts))])
    sample = (rows.where(F.col("u") <= limits[F.col("lang")])
              .select("lang", "u", F.substring("text", 1, excerpt_bytes).alias("text")).distinct()
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("u", "text")))
              .where(F.col("rank") <= wanted))
    excerpts: dict[str, list] = {}
    for r in sample.collect():
        excerpts.setdefault(r.lang, []).append((r.rank, r.text.lower().encode()[:excerpt_bytes]))
    # the most useful content of a raw dictionary is at its end
    dictionaries = {lang: b"\n".join(t for _, t in sorted(parts, reverse=True))[-dict_bytes:]
                    for lang, parts in sorted(excerpts.items(), key=lambda x: (-counts[x[0]], x[0]))}
    return LanguageModel({k: v for k, v in dictionaries.items() if len(v) >= 8}, chunk_bytes, min_margin=min_margin)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
            keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) of every whole text.

    ``score`` is 1 - best / second of the compressed sizes, scaled so that a
    saving of a quarter or more counts as 1; ``margin`` is the saving itself.
    With ``keep`` the input's own columns come instead of the bare id.
    """
    langs = list(model.dictionaries)
    contents = list(model.dictionaries.values())
    chunk, level, least = model.chunk_bytes, model.level, model.min_margin

    def judge_text(text, coders):
        if text is None or not any(map(str.isalpha, text)) or not langs:
            return UNDETERMINED, 0.0, 0.0, True
        data = text.lower().encode()
        if len(data) <= chunk:
            sizes = [len(c(data)) for c in coders]
        else:
            sizes = [0] * len(langs)
            for at in range(0, len(data), chunk):
                piece = data[at: at + chunk]
                for k, c in enumerate(coders):
                    sizes[k] += len(c(piece))
        best = min(range(len(langs)), key=lambda k: (sizes[k], k))
        if len(langs) == 1:
            return langs[0], 1.0, 1.0, False
        second = min(s for k, s in enumerate(sizes) if k != best)
        margin = 1 - sizes[best] / second
        return langs[best], min(1.0, 4 * margin), margin, margin < least

    def judge(batches):
        import zstandard as zstd

        coders = []
        for content in contents:
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False,
                                              write_dict_id=False).compress)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [judge_text(texts[i].as_py(), coders) for i in range(batch.num_rows)]
            columns = [pa.array([f[k] for f in found], t) for k, t in
                       enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            head = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*head, *columns], names=[*batch.schema.names[:-1], "lang_pred", "score", "margin", "rejected"])

    text = F.col(text_col).cast("string").alias("__text")
    if not keep:
        return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text).mapInArrow(judge, _RESULT)
    clash = {"lang_pred", "score", "margin", "rejected", "__text"} & set(docs.columns)
    narrow = docs.drop(*clash)
    schema = extended(narrow.schema, lang_pred=T.StringType(), score=T.DoubleType(), margin=T.DoubleType(), rejected=T.BooleanType())
    return docs.select(*narrow.columns, F.col(text_col).cast("string").alias("__text")).mapInArrow(judge, schema)
