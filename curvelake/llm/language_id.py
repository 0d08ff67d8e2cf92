"""Language identification by compression: the language whose dictionary shortens a text most is its language.

For each language a raw-content zstandard dictionary is made from labelled rows: the words and neighbouring word pairs of
their whole texts are counted in Spark, and the most frequent ones that fit DICT_BYTES are written in ascending
order of frequency, so that the commonest lie nearest to the text. Every text is lower-cased, reduced to its
letters, cut into blocks of BLOCK bytes, and each block is encoded with each dictionary; the sizes of all
blocks are added. Blocks keep long texts from teaching the encoder their own language.

The prediction is the language of the smallest size. It is marked `rejected` when the runner-up is larger by less than
MIN_MARGIN of its own size or by less than MIN_BYTES. Equal sizes - very short texts are stored as they are - go to the
language with more labelled rows, then to the first name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.llm.common import kept, small_batches

FOLDS = 3
HELD_OUT = 1
#: Labelled rows of each language to learn from, the first by hash of doc_id; their whole texts are counted.
ROWS = 2000
DICT_BYTES = 128 * 1024
BLOCK = 1024
LEVEL = 3
MIN_MARGIN = 0.02
MIN_BYTES = 2
UNDETERMINED = "und"
#: Letters of a unit at most: scripts without spaces are cut into pieces in the dictionary.
UNIT_LETTERS = 24


def letters(text: Column) -> Column:
    """Lower case, every run of other characters than letters and their marks as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that nothing is learnt from; a null doc_id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))


def labelled_rows(docs: DataFrame, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(lang, text) of at most `rows` documents per language that may be learnt from, and (lang, n_labelled).

    The counts read two columns. A row passes by the hash of its doc_id when about twice the wanted number would, so that
    what is ranked stays small however many rows a language has.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = usable.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n_labelled"))
    # One row per language.
    near = usable.withColumn("at", F.xxhash64("doc_id")).join(F.broadcast(counts), "lang")
    near = near.filter(F.abs(F.shiftright("at", 1)) <= F.lit(2.0**62) * F.lit(2.0 * rows) / F.col("n_labelled"))
    first = Window.partitionBy("lang").orderBy("at", "doc_id", F.xxhash64("text"))
    return near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= rows).select("lang", "text"), counts


def dictionaries(docs: DataFrame, rows: int = ROWS, size: int = DICT_BYTES) -> list[tuple[str, int, bytes]]:
    """(lang, labelled rows, dictionary content), by descending rows and then name: one string of `size` bytes per language."""
    sample, counts = labelled_rows(docs, rows)
    words = sample.select("lang", F.regexp_extract_all(letters(F.col("text")), F.lit(f"([^ ]{{1,{UNIT_LETTERS}}})"), F.lit(1)).alias("w"))
    pairs = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get("w", i), x))
    units = words.select("lang", F.explode(F.concat("w", pairs)).alias("unit")).groupBy("lang", "unit").agg(F.count(F.lit(1)).alias("n"))
    # A unit takes two bytes at least, so no more than size / 2 of them can fit.
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "unit")
    units = units.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= size // 2)
    units = units.withColumn("bytes", F.sum(F.octet_length("unit") + 1).over(by_count)).filter(F.col("bytes") <= size)
    content = units.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("at"), "unit"))).alias("u"))
    content = content.select("lang", F.array_join("u.unit", " ").alias("content"))
    found = content.join(F.broadcast(counts), "lang").collect()
    return sorted(((r.lang, r.n_labelled, r.content.encode()) for r in found), key=lambda r: (-r[1], r[0]))


def encoder(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def sizes(text: bytes, encoders: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes of the whole text with each dictionary."""
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    return [sum(len(e.compress(b)) for b in blocks) for e in encoders]


def judged(found: list[int]) -> tuple[int, float, int]:
    """The first smallest size, its share when every byte more halves a language's weight, and the margin in bytes."""
    best = min(range(len(found)), key=found.__getitem__)
    rest = found[:best] + found[best + 1 :]
    return best, 1.0 / sum(2.0 ** -min(s - found[best], 1000) for s in found), min(rest, default=0) - found[best]


def identify(
    docs: DataFrame, learnt: list[tuple[str, int, bytes]] | None = None, *, rows: int = ROWS, size: int = DICT_BYTES, min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected for every row of `docs`.

    `learnt` is what `dictionaries` returned; without it the labelled rows of `docs` are used. score is 0 to 1, 1 / languages for a
    tie; margin is the runner-up's surplus in bytes. A null text, one without a letter (\\p{L}), and every text where nothing was
    learnt get `und`, score 0, a null margin and are rejected. One learned language is never rejected, its margin is null.
    Whole texts of any length are encoded. Repeated rows come out as often; an empty table gives an empty one; other
    columns are not read. Dictionaries are languages x `size` bytes in the driver and each worker.
    """
    learnt = dictionaries(docs, rows, size) if learnt is None else learnt
    small_batches(docs.sparkSession)
    names = [lang for lang, _, _ in learnt]
    text = F.col("text").cast("string")
    shown = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        # Marks alone, without a letter, count as no text.
        F.when(text.rlike(r"\p{L}"), letters(text)).alias("_letters"),
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = kept(("language_id", tuple(learnt)), lambda: [encoder(content) for _, _, content in learnt])
        for batch in batches:
            out = []
            for value in batch.column(1):
                raw = value.as_py()
                if raw is None or not encoders:
                    out.append((UNDETERMINED, 0.0, None, True))
                    continue
                found = sizes(raw.encode(), encoders)
                best, score, margin = judged(found)
                one = len(found) == 1
                narrow = not one and (margin < MIN_BYTES or margin < min_margin * (found[best] + margin))
                out.append((names[best], score, None if one else margin, narrow))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int64(), pa.bool_()))]],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    found = shown.mapInArrow(scored, "doc_id long, lang_pred string, score double, margin long, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
