"""Fuzzy line dedup: character shingles, MinHash bands, exact Jaccard verification, distributed union-find.

Equal lines (white space at the ends and A-Z case aside) collapse first, by 64 bits of hash. A distinct line's signature is
one-permutation MinHash over its character shingles, empty bins taking the value of the next full one. Bands of bins deal
lines to buckets; a bucket of two lines is a candidate pair, a larger one links its lines to its least one, and the links
are verified on full shingle sets. Members of a bucket that are still in different components after that are compared with
each other, large buckets block by block, so no link within a bucket is lost. Of each component's lines the first (smallest
doc_id, then line number) stays. Lines of fewer characters than two shingles count as copies only if equal.

One pass in Arrow batches cuts, hashes and signs the lines; the texts of candidates are cut out later, where they lie.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.components import components, merged
from agentlake.llm.shared import hot_join, materialise, narrow
from agentlake.llm.words import U, raw_texts, text_blocks, tidy

#: Texts are gathered into blocks of about so many bytes, which bounds the arrays that a block's signatures take.
LINE_BLOCK_BYTES = 256 << 10
#: Lines that a task remembers to have given a signature.
REMEMBERED = 200_000
#: Rows up to which (counted) a list of lines or buckets is broadcast.
FEW = 1_000_000
#: Members and bytes up to which a bucket is compared whole; of a larger one, at most about so many are in a block.
SMALL_BUCKET, BLOCK, BLOCK_BYTES = 64, 512, 250_000
#: Shingles compared at once by a pair of blocks.
COLUMNS = 4096


@dataclass(frozen=True)
class Settings:
    """At 85 % a pair of lines shares none of 12 bands of 5 with probability (1 - 0.85 ** 5) ** 12 < 0.001."""

    percent: int = 85
    characters: int = 7
    bands: int = 12
    rows: int = 5


#: White space at the ends of a line.
BLANK = " \t\r\x0b\x0c"


def normal(line: bytes) -> bytes:
    return line.strip().lower()


def line_hash(line: bytes) -> int:
    """What Spark's xxhash64 says of the line."""
    x = xxhash.xxh64_intdigest(line, 42)
    return x - (1 << 64) if x >> 63 else x


def mix_in_place(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser on ``x`` itself, with one array of working room."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U(shift)
        x *= U(factor)
    x ^= x >> U(31)
    return x


def mix_short(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser on ``x`` itself."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def rolled(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all windows of k codes, from those of windows half as long, in the integers of ``codes``."""
    whole, length, doubled, kind = None, 0, 1, codes.dtype.type
    power, over = (0x100000001B3, 1 << 64) if codes.itemsize == 8 else (0x9E3779B1, 1 << 32)
    with np.errstate(over="ignore"):
        while True:
            if k & 1:
                whole = codes if whole is None else whole[: len(codes) - length] * kind(power) + codes[length:]
                length += doubled
            k >>= 1
            if not k:
                return whole[: len(codes)] if whole is not codes else codes.copy()
            codes = codes[:-doubled] * kind(power) + codes[doubled:]
            power, doubled = power * power % over, 2 * doubled


def characters(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines, each followed by one more, and the lines' numbers of characters."""
    try:
        flat = b"\n".join([*lines, b""]).decode()
    except UnicodeDecodeError:
        flat = ""
    codes = np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32)
    ends = np.flatnonzero(codes == 10)
    if len(ends) == len(lines):
        return codes, np.diff(ends, prepend=-1) - 1
    # lines that aren't UTF-8 or hold line feeds
    texts = [x.decode("utf-8", "replace") for x in lines]
    return np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32), np.array([len(t) for t in texts], dtype=np.int64)


def parted(sizes: np.ndarray, k: int, inside: np.ndarray, outside) -> np.ndarray:
    """For every place in ``characters`` the line's value of ``inside`` if a window of k starts there and ends in the line, else ``outside``."""
    full = np.maximum(sizes - (k - 1), 0)
    values = np.stack([inside, np.full_like(inside, outside)], axis=1).ravel()
    return np.repeat(values, np.stack([full, sizes + 1 - full], axis=1).ravel())


def shingles(lines: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-character shingles of all lines, each shingle's line, and the lines' numbers of characters."""
    codes, sizes = characters(lines)
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), sizes
    acc = mix_in_place(rolled(codes.astype(np.uint64), k))
    inside = parted(sizes, k, np.ones(len(lines), dtype=bool), False)[:n]
    return acc[inside], np.repeat(np.arange(len(lines), dtype=np.int32), np.maximum(sizes - (k - 1), 0)), sizes


def signatures(lines: list[bytes], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (lines, bands) and which lines have any. A shingle's 32-bit hash says its bin and is its value there."""
    m, none = settings.bands * settings.rows, np.iinfo(np.uint32).max
    codes, sizes = characters(lines)
    low = np.full((len(lines) + 1) * m, none, dtype=np.uint32)  # the last row takes the windows that cross lines
    n = len(codes) - settings.characters + 1
    if n > 0:
        h = mix_short(rolled(codes, settings.characters))
        at = parted(sizes, settings.characters, np.arange(len(lines), dtype=np.int64) * m, len(lines) * m)[:n]
        at += (h >> np.uint32(16)) * np.uint32(m) >> np.uint32(16)
        np.minimum.at(low, at, h)
    low = low.reshape(len(lines) + 1, m)[:-1]
    # an empty bin borrows from the next full one, around the end
    nearest = np.where(low == none, np.int16(2 * m), np.arange(m, dtype=np.int16))
    nearest = np.concatenate([nearest, nearest + np.int16(m)], axis=1)
    nearest = np.minimum.accumulate(nearest[:, ::-1], axis=1)[:, ::-1][:, :m] % m
    low = np.take_along_axis(low, nearest.astype(np.int64), axis=1).astype(np.uint64)
    key = np.zeros((len(lines), settings.bands), dtype=np.uint64) + np.arange(1, settings.bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(settings.rows):
            key *= U(0x9E3779B97F4A7C15)
            key += low[:, j :: settings.rows]
        mix_in_place(key)
    return key.view(np.int64), sizes >= 2 * settings.characters


@tidy
def _lines(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """(doc_id, place, line_no, line, buckets) of lines with text. ``place`` names the row: its id, or its text's hash for
    want of one. Buckets come with one of a line's rows in each part of the texts, if the line is long enough for any."""
    seen: set[int] = set()
    digest, least = xxhash.xxh64_intdigest, 2 * settings.characters
    for batch in batches:
        for ids, texts in text_blocks(batch, LINE_BLOCK_BYTES):
            if len(seen) > REMEMBERED:
                seen.clear()
            places, upto, numbers, hashes, new, at = [], [0], [], [], [], []
            for doc_id, text in zip(ids.to_pylist(), raw_texts(texts), strict=True):
                places.append(line_hash(text or b"") if doc_id is None else doc_id)
                for n, x in enumerate((text or b"").lower().split(b"\n")):
                    x = x.strip()
                    if x:
                        h = digest(x, 42)
                        if len(x) >= least and h not in seen:
                            seen.add(h)
                            new.append(x)
                            at.append(len(hashes))
                        numbers.append(n)
                        hashes.append(h)
                upto.append(len(hashes))
            row = np.repeat(np.arange(len(places)), np.diff(upto))
            key, fuzzy = signatures(new, settings)
            sizes = np.zeros(len(hashes), dtype=np.int32)
            sizes[np.array(at, dtype=np.int64)[fuzzy]] = settings.bands
            edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            columns = [ids.take(pa.array(row)), pa.array(np.array(places, dtype=np.int64)[row]), pa.array(numbers, pa.int32()), pa.array(np.array(hashes, dtype=np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(edges, pa.array(key[fuzzy].ravel()))], ["doc_id", "place", "line_no", "line", "buckets"])


LINES = "doc_id long, place long, line_no int, line long, buckets array<bigint>"


def similar(a: list[bytes], b: list[bytes], settings: Settings) -> np.ndarray:
    """Whether lines at the same place are links, by their full sets of shingles.

    One sort: a value is its pair in the highest bits, its shingle's hash in the next, its side in the last; the fewer
    pairs, the more bits of hash.
    """
    h, owner, _ = shingles([*a, *b], settings.characters)
    side = owner >= len(a)
    above = max(1, (len(a) - 1).bit_length())
    values = (h >> U(above)) & ~U(1)
    values |= (owner - len(a) * side).astype(np.uint64) << U(64 - above)
    values |= side
    values.sort()
    values = values[np.concatenate([np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1]])]
    pair = (values >> U(64 - above)).astype(np.int64)
    both = np.bincount(pair[1:][values[1:] ^ values[:-1] == 1], minlength=len(a))
    union = np.bincount(pair, minlength=len(a)) - both
    return 100 * both >= settings.percent * np.maximum(1, union)


@tidy
def _verified(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(size, (int(size[first - 1]) if first else 0) + LINE_BLOCK_BYTES, side="right")))
            part = batch.slice(first, last - first)
            ok = pa.array(similar(part.column(2).to_pylist(), part.column(3).to_pylist(), settings))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], ["a", "b"])
            first = last


def _shared(h: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct shingles of ``h`` two owners both hold (count, count), and how many each holds."""
    order = np.argsort(h)
    h, owner = h[order], owner[order].astype(np.int64)
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    at = np.cumsum(new) - 1
    held = np.bincount(at, minlength=1)
    alone = held[at] == 1  # counts in no intersection
    sizes = np.bincount(owner[alone], minlength=count).astype(np.int64)
    several = int((held > 1).sum())
    at, owner = (np.cumsum(held > 1) - 1)[at[~alone]], owner[~alone]
    both = np.zeros((count, count), dtype=np.int64)
    for first in range(0, several, COLUMNS):
        a, b = np.searchsorted(at, [first, first + COLUMNS])
        part = np.zeros((count, min(COLUMNS, several - first)), dtype=np.float32)
        part[owner[a:b], at[a:b] - first] = 1
        both += (part @ part.T).astype(np.int64)
        sizes += part.sum(1).astype(np.int64)
    return both, sizes


def _compared(settings: Settings):
    def run(table: pa.Table) -> pa.Table:
        """Links within each bucket of ``table`` (whole small ones, or two blocks of a large one), one for each pair of components they join."""
        table = table.sort_by("bucket")
        bucket, ids, c, block = (table[k].to_numpy() for k in ("bucket", "line", "c", "block"))
        across = table["low"][0].as_py() != table["high"][0].as_py()
        h, owner, _ = shingles(table["text"].to_pylist(), settings.characters)
        upto = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(ids)))])
        parent: dict = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out: list[list] = [[], []]
        for a, b in pairwise(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()):
            first, last = upto[a], upto[b]
            both, n = _shared(h[first:last], owner[first:last] - a, b - a)
            part, i_c, i_block = ids[a:b], c[a:b], block[a:b]
            linked = 100 * both >= settings.percent * np.maximum(1, n[:, None] + n[None, :] - both)
            linked &= (i_c[:, None] != i_c[None, :]) & (part[:, None] > part[None, :])
            if across:
                linked &= i_block[:, None] != i_block[None, :]
            for i, j in zip(*np.nonzero(linked), strict=True):
                x, y = root(i_c[i]), root(i_c[j])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out[0].append(int(part[i]))
                    out[1].append(int(part[j]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def open_links(told: DataFrame, found: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between different components within buckets.

    ``told``: bucket, line, c. ``found``: line, text. Both lines of a bucket of two have been compared. Small buckets are
    dealt over tasks several at a time; the comparison of a large one costs its square, dealt by pairs of blocks.
    """
    signs = (F.bit_xor(F.xxhash64("line", F.lit(k))).alias(f"sign_{k}") for k in (1, 2))
    heads = told.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("members"), *signs).filter("low <> high and members > 2")
    # of buckets with the same members one is enough
    heads = materialise(heads.groupBy("members", "sign_1", "sign_2").agg(F.min("bucket").alias("bucket")).select("bucket"), "heads")
    open_ = materialise(told.join(narrow(heads, FEW), "bucket").join(found, "line").select("bucket", "line", "c", "text"), "open")
    sizes = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum(F.octet_length("text")).alias("size"))
    sizes = sizes.withColumn("small", (F.col("members") <= SMALL_BUCKET) & (F.col("size") <= BLOCK_BYTES))
    sizes = materialise(sizes.withColumn("blocks", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("size") / BLOCK_BYTES)).cast("int")), "sizes")
    groups = 1 + (sizes.filter("small").agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES
    rows = open_.join(sizes, "bucket")
    few = rows.filter("small").select(F.pmod(F.xxhash64("bucket"), F.lit(groups)).alias("deal"), F.lit(-1).alias("low"), F.lit(-1).alias("high"), "bucket", "line", "c", F.lit(0).alias("block"), "text")
    many = rows.filter("not small").withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    with_each = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = with_each.select(F.col("bucket").alias("deal"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "bucket", "line", "c", "block", "text")
    return few.unionByName(dealt).groupBy("deal", "low", "high").applyInArrow(_compared(settings), "a long, b long")


def candidates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): lines that share a bucket with its least line; (bucket, line): members of buckets of more than two."""
    dealt = lines.select("line", F.explode("buckets").alias("bucket"))
    # a line comes once for each part of the texts that holds it, so a bucket's count is no less than its lines
    met = dealt.groupBy("bucket").agg(F.min("line").alias("head"), F.max("line").alias("last"), F.count(F.lit(1)).alias("members"))
    met = materialise(met.filter("head <> last"), "met")
    twos = met.filter("members = 2").select(F.col("last").alias("a"), F.col("head").alias("b"))
    large = met.filter("members > 2").select("bucket", "head")
    shared = materialise(dealt.join(narrow(large, FEW), "bucket").distinct(), "shared")
    pairs = twos.union(shared.filter("line <> head").select("line", "head")).distinct()
    return materialise(pairs, "pairs"), shared.select("bucket", "line")


def line_texts(need: DataFrame, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(line, text) in normal form of the lines ``need`` (line, repeated or not), each cut out of one document that holds it."""
    where = lines.join(narrow(need, FEW), "line", "left_semi").groupBy("line").agg(F.min("place").alias("place"), F.min_by("line_no", "place").alias("line_no"))
    where = where.groupBy("place").agg(F.collect_list(F.struct("line", "line_no")).alias("wanted"))  # lines of one document
    placed = texts.withColumn("place", F.coalesce("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))))
    cut = placed.join(narrow(materialise(where, "where"), FEW), "place").select("wanted", F.split("text", "\n", -1).alias("cut"))
    raw = cut.select(F.explode(F.transform("wanted", lambda w: F.struct(w["line"].alias("line"), F.get("cut", w["line_no"]).alias("raw")))).alias("w")).select("w.*")
    # letter by letter only where a text isn't ASCII
    low = F.when(F.octet_length("raw") == F.char_length("raw"), F.lower("raw")).otherwise(F.translate("raw", string.ascii_uppercase, string.ascii_lowercase))
    text = F.trim(low, F.lit(BLANK))
    # a place that two rows share may hold other lines as well
    return raw.select("line", text.alias("text")).filter(F.xxhash64("text") == F.col("line")).groupBy("line").agg(F.first(F.encode("text", "utf-8")).alias("text"))


def line_decisions(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, line_no (from 0), line (hash), component, kept for every line with text of ``docs`` (doc_id, text).

    Null and blank texts have no such lines. Lines of rows with a null doc_id come last in the order and are told apart
    by line number only; rows that repeat a doc_id with one text keep their first lines alike. A very long text counts
    whole. Empty tables give no rows; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = materialise(texts.mapInArrow(partial(_lines, settings=settings), LINES), "lines")
    pairs, shared = candidates(lines)
    need = pairs.select(F.explode(F.array("a", "b")).alias("line"))
    if 2 * pairs.count() > FEW:
        need = materialise(need.distinct(), "need")
    found = materialise(line_texts(need, lines, texts), "line_texts")
    lines = lines.drop("place", "buckets")
    side = lambda x: found.select(F.col("line").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    links = materialise(both.mapInArrow(partial(_verified, settings=settings), "a long, b long"), "links")
    label = components(links)
    told = shared.join(narrow(label.withColumnRenamed("id", "line"), FEW), "line", "left").select("bucket", "line", F.coalesce("component", "line").alias("c"))
    more = materialise(open_links(told, found, settings), "more")
    if more.limit(1).count():
        label = merged(label, more)
    label = narrow(label.withColumnRenamed("id", "line"), FEW)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    firsts = lines.groupBy("line").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    # a line that comes once and is in no component stays as it is
    firsts = materialise(firsts.join(label, "line", "left").filter("times > 1 or component is not null").withColumn("component", F.coalesce("component", "line")), "firsts")
    chosen = materialise(firsts.groupBy("component").agg(F.min("first").alias("stays"), F.count(F.lit(1)).alias("variants")), "chosen")
    firsts = firsts.select("line", "component", "times")
    if chosen.count() <= FEW:
        firsts = firsts.join(F.broadcast(chosen.drop("variants")), "component", "left")
    else:
        firsts = hot_join(firsts, chosen, ["component"], "variants")
    firsts = materialise(firsts.select("line", "component", "times", F.col("stays.doc_id").alias("stays_id"), F.col("stays.line_no").alias("stays_no")), "decided")
    if firsts.limit(FEW + 1).count() <= FEW:
        told = lines.join(F.broadcast(firsts.drop("times")), "line", "left")
    else:
        told = hot_join(lines, firsts, ["line"], "times")
    stays = F.col("doc_id").eqNullSafe(F.col("stays_id")) & (F.col("line_no") == F.col("stays_no"))
    return told.select("doc_id", "line_no", "line", F.coalesce("component", "line").alias("component"), (F.col("component").isNull() | stays).alias("kept"))


def document_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_lines, n_kept, dropped (line numbers, ascending) for every doc_id of ``docs``."""
    told = line_decisions(docs, settings).select("doc_id", "line_no", "kept")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("boolean").alias("kept"))
    return told.unionByName(ids).groupBy("doc_id").agg(
        F.count("line_no").alias("n_lines"),
        F.coalesce(F.sum(F.col("kept").cast("long")), F.lit(0)).alias("n_kept"),
        F.sort_array(F.collect_set(F.when(~F.col("kept"), F.col("line_no")))).alias("dropped"),
    )


def without_repeated_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with the lines that aren't kept taken out of their texts; nothing else changes."""
    told = document_lines(docs, settings).select(F.col("doc_id").alias("_agentlake_id"), F.col("dropped").alias("_agentlake_dropped"))
    lines = F.split(F.col("text"), "\n", -1)
    stay = F.filter(lines, lambda x, i: ~F.array_contains(F.col("_agentlake_dropped"), i))
    joined = docs.join(told, docs["doc_id"].cast("long").eqNullSafe(F.col("_agentlake_id")), "left")
    return joined.withColumn("text", F.when(F.size("_agentlake_dropped") > 0, F.array_join(stay, "\n")).otherwise(F.col("text"))).select(*docs.columns)
