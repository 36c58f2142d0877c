"""Best-fit packing of tokenised documents by linear grouping.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut. Full pieces are sequences of
their own. Of the rest, large pieces are sorted by length and put into groups of equal cardinality; lengths round up
to the largest of the group, so few sizes are left. Configurations (how many of each size share a sequence) are built
by subset sums, the best filled first, each used as often as its sizes allow; then actual pieces take their group's
places. Small pieces go best-fit into what room is left, longest first. All planning works on counts by length and by
room left, at most ``capacity`` numbers each, so it is as large for 100 TB as for 1 GB; pieces find their place by
their rank.
"""

from __future__ import annotations

import json
import sys
import types
import zlib
from array import array
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentlake.llm.shared import materialise, with_prefix
from agentlake.llm.words import text_blocks, tidy

CAPACITY, END = 4096, 1
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The model's letter for each byte: printable ones are themselves, the others follow from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
SHOWN = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: About the most bytes that a task remembers chunks in, and what an entry takes beside its letters and ids.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 180
#: Marks between an ASCII letter and white space: a run of them is a pre-token of its own.
MARKS = r"([a-z])([.,;:!?*$%&#|]+)([\x09-\x0d\x20]|\z)"
#: The normaliser and pre-tokenizer for which the parts below are encoded independently.
LOWERING = ["NFC", "Replace", "Lowercase"]
PRE_TOKENS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def parts(texts: pa.Array) -> pa.Array:
    """Lists of the parts of texts that such a tokenizer encodes independently: white-space delimited, A-Z in lower case (as
    it does itself, but for its special tokens), with marks after a word parted from it. Fewer distinct parts, the same ids."""
    special = pc.match_substring(texts, "<|")
    low = pc.ascii_lower(texts)
    if pc.any(special).as_py():
        low = pc.if_else(special, texts, low)
    return pc.ascii_split_whitespace(pc.replace_substring_regex(low, MARKS, r"\1 \2\3"))


class Encoded(dict):
    """Chunk -> its token ids as little-endian 32-bit bytes, remembered within a task up to a bound in bytes.

    A chunk of small Latin letters is one pre-token that normalisation leaves alone, so the model alone encodes it. Other
    unknown chunks of a block of texts go through the whole tokenizer together, each token to the chunk its offset lies in.
    A tokenizer with other rules encodes each text as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.held = self.tokenizer.model, 0
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        lowering = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers") or []]
        self.by_chunk = lowering == LOWERING and (steps[0].get("pattern") or {}).get("Regex") == PRE_TOKENS

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def learn(self, new: list[bytes]) -> None:
        other, tokenize = [], self.model.tokenize
        for w in new:
            if w.isalpha() and w.islower():  # ASCII letters
                self[w] = array("I", [t.id for t in tokenize(w.decode())]).tobytes()
                continue
            text = w.decode("utf-8", "replace")
            if text.isalpha() and text.islower() and max(text) < "\u0250":
                self[w] = array("I", [t.id for t in tokenize(w.decode("latin-1").translate(SHOWN))]).tobytes()
            else:
                other.append((w, text))
        for at in range(0, len(other), 20_000):
            part, words = zip(*other[at : at + 20_000], strict=True)
            starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
            found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4").tobytes()
            first = 4 * np.searchsorted(np.array([o[0] for o in found.offsets], dtype=np.int64), np.append(starts, 1 << 60))
            self.update((w, ids[a:b]) for w, a, b in zip(part, first[:-1].tolist(), first[1:].tolist(), strict=True))
        self.held += sum(len(w) + len(self[w]) + ENTRY_BYTES for w in new)

    def encode(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        """The ids of all texts in one buffer, and where in it each text's begin (with the last one's end)."""
        if not self.by_chunk:
            each = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts.to_pylist()]
            return memoryview(b"".join(each)), [0, *np.cumsum([len(x) for x in each]).tolist()]
        found = parts(texts)
        coded = found.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        if self.held > CACHE_BYTES:
            self.forget()
        self.learn([w for w in distinct if w not in self])
        ids = pa.array(list(map(self.__getitem__, distinct)), pa.large_binary()).take(coded.indices)
        _, offsets, values = ids.buffers()
        upto = np.frombuffer(offsets, dtype=np.int64)[ids.offset :] if len(ids) else np.zeros(1, np.int64)
        at = found.offsets.to_numpy() - found.offsets[0].as_py()
        return memoryview(values if values is not None else b""), upto[at].tolist()


def encoder(path: str) -> Encoded:
    """One for each Python worker; the tokenizer is kept from task to task, the chunks aren't."""
    kept = sys.modules.setdefault("agentlake_worker_state", types.ModuleType("agentlake_worker_state")).__dict__
    if ("encoded", path) not in kept:
        kept["encoded", path] = Encoded(path)
    return kept["encoded", path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@tidy
def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int) -> Iterator[pa.RecordBatch]:
    encoded = encoder(path or default_vocabulary())
    end, step = np.array([END], dtype="<u4").tobytes(), 4 * capacity
    for batch in batches:
        for ids, texts in text_blocks(batch):
            out: list[list] = [[], [], [], [], []]
            tokens, edges = encoded.encode(pc.fill_null(texts, ""))
            for doc_id, (first, last) in zip(ids.to_pylist(), pairwise(edges), strict=True):
                size = last - first + len(end)
                for piece, at in enumerate(range(0, size, step)):
                    stop = min(at + step, size)
                    crc = zlib.crc32(tokens[first + at : min(first + stop, last)])
                    if stop == size:
                        crc = zlib.crc32(end, crc)
                    for column, value in zip(out, (doc_id, piece, at // 4, (stop - at) // 4, crc), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])
    encoded.forget()


def tokenised(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(partial(_pieces, path=path, capacity=capacity), PIECE)


# --- planning on counts (driver, bounded by the capacity) ---


def best_filled(sizes: list[int], counts: list[int], capacity: int) -> dict[int, int]:
    """The fullest configuration that holds the largest size left: index of size -> times. ``sizes`` ascend."""
    live = [i for i, c in enumerate(counts) if c]
    top = live[-1]
    mask, reach = (1 << capacity + 1) - 1, [1]
    for i in live:
        r = reach[-1]
        for j in range(1, min(counts[i] - (i == top), capacity // sizes[i]) + 1):
            r |= reach[-1] << sizes[i] * j
        reach.append(r & mask)
    x = (reach[-1] & ((1 << capacity - sizes[top] + 1) - 1)).bit_length() - 1
    out = {top: 1}
    for k in range(len(live) - 1, -1, -1):
        i = live[k]
        for j in range(min(counts[i] - (i == top), x // sizes[i]), -1, -1):
            if reach[k] >> (x - j * sizes[i]) & 1:
                if j:
                    out[i] = out.get(i, 0) + j
                x -= j * sizes[i]
                break
    return out


def plan_large(counts: dict[int, int], capacity: int, groups: int) -> tuple[np.ndarray, int]:
    """Places for pieces ranked by length, longest first: rows (first rank, first bin, pieces in each bin), and bins used."""
    lengths = sorted(counts, reverse=True)
    n = sum(counts.values())
    groups = max(1, min(groups, n))
    edges = [n * g // groups for g in range(groups + 1)]
    upto = np.cumsum([counts[x] for x in lengths])
    # a group's pieces round up to its first, longest one; ascending order for the subset sums
    size = [lengths[int(np.searchsorted(upto, edges[g], side="right"))] for g in range(groups)][::-1]
    left = [edges[g + 1] - edges[g] for g in range(groups)][::-1]
    rank = [edges[g] for g in range(groups)][::-1]
    places, bins = [], 0
    while any(left):
        used = best_filled(size, left, capacity)
        times = min(left[i] // m for i, m in used.items())
        for i, m in used.items():
            places.append((rank[i], bins, m))
            rank[i] += m * times
            left[i] -= m * times
        bins += times
    return np.array(sorted(places), dtype=np.int64).reshape(-1, 3), bins


def plan_small(counts: dict[int, int], room: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit, longest first, into bins ranked by room left: rows (first rank of pieces, first rank of bins, pieces in
    each bin). A bin takes as many pieces of a length as fit before the next, as one by one best fit would have it."""
    runs: dict[int, deque] = {}
    rank = 0
    for r in sorted(room):
        runs[r] = deque([(rank, room[r])])
        rank += room[r]
    classes = sorted(runs)
    places, piece = [], 0

    def add(r: int, at: int, n: int) -> None:
        if r not in runs:
            insort(classes, r)
            runs[r] = deque()
        runs[r].append((at, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(classes, length)
            if k == len(classes):  # no room anywhere: open bins
                each = capacity // length
                n = max(1, left // each)
                add(capacity, rank, n)
                rank += n
                continue
            r = classes[k]
            at, n = runs[r].popleft()
            m = min(r // length, left)
            t = min(n, left // m)
            if t < n:
                runs[r].appendleft((at + t, n - t))
            elif not runs[r]:
                del runs[r]
                classes.pop(k)
            places.append((piece, at, m))
            piece += m * t
            left -= m * t
            add(r - m * length, at, t)
    return np.array(places, dtype=np.int64).reshape(-1, 3)


def placed(places: np.ndarray):
    """rank -> bin, as a pandas function."""

    @F.pandas_udf("long")
    def at(rank: pd.Series) -> pd.Series:
        x = rank.to_numpy(dtype=np.int64)
        p = places[np.searchsorted(places[:, 0], x, side="right") - 1]
        return pd.Series(p[:, 1] + (x - p[:, 0]) // p[:, 2])

    return at


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, groups: int = 1024, small: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``docs``.

    Null and empty texts are one piece of the end token alone. Repeated rows are rows of their own; an empty table gives
    no rows. ``small``: greatest length that counts as small (a quarter of the capacity unless given).
    """
    small = small or max(1, capacity // 4)
    pieces = materialise(tokenised(docs, path, capacity), "pieces")
    whole = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(F.col("length") < capacity).withColumn("_down", -F.col("length"))
    counts = {r[0]: r[1] for r in rest.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if not counts:
        return whole.select(*pieces.columns, "sequence_id", "offset")
    order = ["_down", "doc_id", "piece", "start", "ids_crc32"]
    ranked = with_prefix(rest, order, "length", "by_length").drop("prefix", "_down")
    n_large = sum(c for x, c in counts.items() if x > small)
    keep = [*pieces.columns]
    bins, room, large = 0, {}, None
    if n_large:
        places, bins = plan_large({x: c for x, c in counts.items() if x > small}, capacity, groups)
        large = materialise(ranked.filter(F.col("length") > small).withColumn("bin", placed(places)("row_index")).select(*keep, "bin"), "large")
        left = large.groupBy("bin").agg((capacity - F.sum("length")).cast("long").alias("room"))
        by_room = materialise(with_prefix(left, ["room", "bin"], "room", "by_room").select("bin", "room", F.col("row_index").alias("at")), "rooms")
        room = {r[0]: r[1] for r in by_room.groupBy("room").count().collect()}  # at most ``capacity`` rows
    little = None
    if n_large < sum(counts.values()):
        places = plan_small({x: c for x, c in counts.items() if x <= small}, room, capacity)
        little = ranked.filter(F.col("length") <= small).withColumn("at", placed(places)(F.col("row_index") - n_large)).select(*keep, "at")
        if n_large:
            little = little.join(by_room.select("at", "bin"), "at", "left").select(*keep, F.coalesce("bin", "at").alias("bin"))
        else:
            little = little.withColumnRenamed("at", "bin")
    both = large if little is None else little if large is None else large.unionByName(little)
    inside = Window.partitionBy("bin").orderBy(F.desc("length"), "doc_id", "piece", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("offset", F.sum("length").over(inside) - F.col("length")).withColumn("sequence_id", 2 * F.col("bin"))
    return both.select(*keep, "sequence_id", "offset").unionByName(whole.select(*keep, "sequence_id", "offset"))
