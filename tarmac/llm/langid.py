"""Language identification by compression.

Each language has a zstandard raw-content dictionary made from a bounded sample of its texts, of each of which windows are
drawn from its whole length, so that openings shared by all languages don't fill it. Languages are any number; they are held
against a text in blocks. A text, as its distinct lower-cased words in order, so that its own repetitions don't count, is
compressed in pieces with every dictionary; the smallest sum of sizes names the language. The score is the share of the
runner-up's size that the winner saves, in 0 to 1; where it or the bytes saved are few, callers that ask for it reject.

Null texts and texts without a letter are UNDETERMINED with score 0. Ties go to the language with more training texts. Long
texts are compressed piece by piece, one text a step; an empty table gives an empty result.
Training rows without text or language are left out; without any, all texts are UNDETERMINED. Repeated rows and further
columns change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, id_text

UNDETERMINED = "und"
#: Bounds of the model: texts sampled for each language, windows of each and their characters, bytes of a dictionary. Texts
#: no longer than all their windows are used whole.
SAMPLE_TEXTS = 1024
WINDOWS, WINDOW_CHARS = 4, 256
DICTIONARY_BYTES = 400 << 10
#: Languages whose dictionaries are held ready at once.
BLOCK_LANGUAGES = 256
#: Characters of a piece. Pieces shorter than the dictionary keep it, not the text itself, the reference.
PIECE = 4096
LEVEL = 6
SCHEMA = "doc_id long, lang_pred string, score double"


#: Windows at hashed places of the whole text, less the words that their edges cut.
PIECES = rf"""
if(char_length(text) <= {WINDOWS * WINDOW_CHARS}, text,
 array_join(transform(sequence(1, {WINDOWS}), k ->
  regexp_replace(substring(text, cast(1 + pmod(xxhash64(doc_id, k), char_length(text) - {WINDOW_CHARS - 1}) as int), {WINDOW_CHARS}), '^\\S*\\s|\\s\\S*$', '')), ' '))
"""


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """The dictionary of each language, from up to sample_texts texts each, chosen by a hash of the id."""
    rows = id_text(docs, id_col, text_col, F.col(lang_col).alias("lang")).where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    counts = dict(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect())
    if not counts:
        return {}
    draw = F.xxhash64(F.col("doc_id"), F.lit(7))
    # Enough for sample_texts of each language and more, so that the exact choice below sorts few rows.
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, (2 * sample_texts + 64) / n)) for k, n in counts.items()], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").where((F.pmod(draw, F.lit(1 << 30)) / float(1 << 30)) < F.col("share"))
    few = drawn.select("lang", draw.alias("draw"), "doc_id", F.expr(PIECES).alias("text"))
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))).where(F.col("n") <= sample_texts)
    # A language's rows lie together; the driver holds the texts of one at a time.
    made = {}
    for k, own in groupby(few.select("lang", "n", "text").toLocalIterator(), lambda r: r["lang"]):
        made[k] = " ".join(prepared(t) for _, t in sorted((r["n"], r["text"]) for r in own)).encode()[-DICTIONARY_BYTES:]
    return {k: made[k] for k in counts if k in made}


def prepared(text: str) -> str:
    return f" {' '.join(dict.fromkeys(text.lower().split()))} "


def judge(dictionaries: dict[str, bytes]) -> Callable[[list[str | None]], list[tuple[str, float, int]]]:
    """A function from texts to the language and score of each, and the bytes that the winner saves."""
    import regex
    import zstandard as zstd

    letter, names = regex.compile(r"\p{L}"), list(dictionaries)
    blocks = [names[k : k + BLOCK_LANGUAGES] for k in range(0, len(names), BLOCK_LANGUAGES)]

    def compressors(block: list[str]) -> list:
        out = []
        for name in block:
            made = zstd.ZstdCompressionDict(dictionaries[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            out.append(zstd.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    ready = compressors(names) if len(blocks) == 1 else None

    def judged(texts: list[str | None]) -> list[tuple[str, float]]:
        # The two smallest sizes so far, and the language of the smallest.
        least: list[tuple] = [(None, None, UNDETERMINED)] * len(texts)
        for block in blocks:
            held = ready or compressors(block)
            for i, text in enumerate(texts):
                if not text or not letter.search(text):
                    continue
                whole = prepared(text)
                pieces = [whole[k : k + PIECE].encode("utf-8", "replace") for k in range(0, len(whole), PIECE)]
                sizes = [sum(len(c.compress(p)) for p in pieces) for c in held]
                best, *rest = sorted([*sizes, *(x for x in least[i][:2] if x is not None)])[:2]
                name = least[i][2] if best == least[i][0] else block[sizes.index(best)]
                least[i] = (best, rest[0] if rest else None, name)
        alone = (1.0, 1 << 30)  # one language only: nothing to save on
        return [(name, *((0.0, 0) if best is None else alone if second is None else (1.0 - best / second, second - best))) for best, second, name in least]

    return judged


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = judge(sent.value)
        for batch in by_bytes(batches):
            found = judged(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], least_score: float, least_bytes: int = 0, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is found with at least this score and so many bytes saved."""
    at, sent = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = judge(sent.value)
        for batch in batches:
            found = judged(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UNDETERMINED and score >= least_score and saved >= least_bytes for x, score, saved in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
