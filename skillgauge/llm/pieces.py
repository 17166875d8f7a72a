"""SentencePiece encoding and decoding of whole batches by suffix-array matching.

The texts of a batch are cut where no piece can reach across, equal parts are kept
once, and the concatenation of the parts is indexed by a suffix array. Every piece
of the vocabulary is looked up in it by binary search, which gives the range of its
occurrences: edges from start to end. The edges are sorted by end position and
relaxed: an edge extends the encoding of the part up to its start if its piece may
follow the last piece there. For a vocabulary of merges exactly one edge into each
position does, so the path is the one that merging gives.

A pair of pieces may follow each other if merging their joined text would not join
them; that is found by undoing the merges of both along their common border.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partition_map

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Characters of a batch that are indexed together, more or less.
BATCH_CHARACTERS = 6_000_000
NONE = np.int64(-1)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model with the tables that encoding needs, all of the vocabulary's size."""

    text: list[str]
    ids: dict[str, int]
    byte_ids: list[int]
    out: list[bytes]
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    joins: np.ndarray
    joined: np.ndarray
    known: np.ndarray
    cuts_at_space: bool
    padded: np.ndarray
    lengths: np.ndarray
    order: np.ndarray
    verdicts: dict


@functools.lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    """The tables of a serialized model; a worker makes them once."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = processor.vocab_size()
    text = [processor.id_to_piece(i) for i in range(n)]
    special = np.array([processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i) for i in range(n)])
    byte_ids = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    out = [b"" if special[i] else text[i].replace(SPACE, " ").encode() for i in range(n)]
    for b, i in enumerate(byte_ids):
        out[i] = bytes([b])
    ids = {t: i for i, t in enumerate(text) if not special[i]}
    # Rank 0 for characters, which no merge makes; merged pieces in order of falling score.
    rank = np.zeros(n, np.int64)
    merged = sorted((i for i in ids.values() if len(text[i]) > 1), key=lambda i: (-processor.get_score(i), i))
    rank[merged] = np.arange(1, len(merged) + 1)
    left, right = np.arange(n), np.arange(n)
    joins = {}
    for i in merged:
        t = text[i]
        for cut in range(1, len(t)):
            a, b = ids.get(t[:cut]), ids.get(t[cut:])
            if a is not None and b is not None:
                joins[a * n + b] = i
    for i in merged:
        left[i], right[i] = last_merge(text[i], ids, rank, i)
    keys = np.array(sorted(joins), np.int64)
    known = np.zeros(0x110000, bool)
    known[[ord(t) for t in ids if len(t) == 1]] = True
    real = np.array(sorted(ids.values()), np.int64)
    lengths = np.array([len(text[i]) for i in real])
    padded = np.zeros((len(real), int(lengths.max())), np.int64)
    for row, i in enumerate(real):
        padded[row, : len(text[i])] = [ord(c) for c in text[i]]
    return Vocabulary(
        text, ids, byte_ids, out, rank, left, right, keys, np.array([joins[k] for k in keys.tolist()], np.int64), known,
        not any(SPACE in t.lstrip(SPACE) for t in ids), padded, lengths, real, {"keys": np.zeros(0, np.int64), "good": np.zeros(0, bool)},
    )


def last_merge(text: str, ids: dict[str, int], rank: np.ndarray, whole: int) -> tuple[int, int]:
    """The two pieces whose merge completes `text`; the piece itself twice if merging never makes it."""
    parts = list(text)
    while len(parts) > 2:
        best = min(((rank[ids[a + b]], at) for at, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids), default=None)
        if best is None:
            return whole, whole
        at = best[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (ids[parts[0]], ids[parts[1]]) if all(p in ids for p in parts) else (whole, whole)


def may_follow(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the joined text of pieces a and b leaves them as they are, for arrays of pairs."""
    n = len(v.text)
    good = np.ones(len(a), bool)
    limit = np.full(len(a), np.iinfo(np.int64).max)
    live = np.arange(len(a))
    a, b = a.copy(), b.copy()
    while len(live):
        x, y = a[live], b[live]
        key = x * n + y
        at = np.minimum(np.searchsorted(v.joins, key), len(v.joins) - 1)
        hit = v.joins[at] == key
        bad = hit & (v.rank[v.joined[at]] < limit[live])
        good[live[bad]] = False
        rx, ry = v.rank[x], v.rank[y]
        undo_a = rx > ry
        # The later merge is undone: of equal ones that of b, as merging goes from left to right.
        limit[live] = np.where(undo_a, rx, ry + 1)
        a[live] = np.where(undo_a, v.right[x], x)
        b[live] = np.where(undo_a, y, v.left[y])
        stuck = (a[live] == x) & (b[live] == y)
        live = live[~bad & ~stuck]
    return good


def allowed(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`may_follow` with the verdicts of all pairs met before, which a worker keeps up to a bound."""
    key = a * len(v.text) + b
    fresh = np.unique(key)
    known, good = v.verdicts["keys"], v.verdicts["good"]
    if len(known):
        at = np.minimum(np.searchsorted(known, fresh), len(known) - 1)
        fresh = fresh[known[at] != fresh]
    if len(fresh):
        verdict = may_follow(v, fresh // len(v.text), fresh % len(v.text))
        if len(known) > 4_000_000:
            known, good = known[:0], good[:0]
            fresh = np.unique(key)
            verdict = may_follow(v, fresh // len(v.text), fresh % len(v.text))
        both = np.concatenate([known, fresh])
        order = np.argsort(both, kind="stable")
        v.verdicts["keys"], v.verdicts["good"] = both[order], np.concatenate([good, verdict])[order]
    return v.verdicts["good"][np.searchsorted(v.verdicts["keys"], key)]


def suffix_array(points: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the `depth` characters that start there (or more), by doubling."""
    distinct = np.unique(points)
    rank = np.zeros(int(distinct.max()) + 1, np.int64)
    rank[distinct] = np.arange(1, len(distinct) + 1)
    key = rank[points]
    # As many characters as fit are packed into the first key.
    bits, width = int(len(distinct)).bit_length(), 1
    while width * 2 * bits <= 62 and width < depth:
        key = (key << (bits * width)) | shifted(key, width)
        width *= 2
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        ordered = key[order]
        rank = np.empty_like(key)
        rank[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]))
        key = rank * (int(rank.max()) + 1) + shifted(rank, width)
        width *= 2


def shifted(values: np.ndarray, by: int) -> np.ndarray:
    """values[i + by], and 0 beyond the end."""
    out = np.zeros_like(values)
    out[: max(0, len(values) - by)] = values[by:]
    return out


def ranges(v: Vocabulary, points: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range of suffixes that start with it, by binary search over all pieces at once."""
    depth = v.padded.shape[1]
    text = np.concatenate([points, np.zeros(depth, points.dtype)])
    inside = np.arange(depth) < v.lengths[:, None]

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(v.lengths), np.int64), np.full(len(v.lengths), len(suffixes))
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            differ = np.where(inside[open_], text[suffixes[middle][:, None] + np.arange(depth)] - v.padded[open_], 0)
            first = differ[np.arange(len(open_)), (differ != 0).argmax(1)]
            right = first <= 0 if upper else first < 0
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)

    return bound(False), bound(True)


def encode_parts(v: Vocabulary, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts one after the other, and the number of ids of each. Parts hold known characters only."""
    joined = "\0".join(parts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    suffixes = suffix_array(points, v.padded.shape[1])
    low, high = ranges(v, points, suffixes)
    many = high - low
    piece = np.repeat(v.order, many)
    start = suffixes[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    end = start + np.repeat(v.lengths, many)

    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    first = np.cumsum(lengths + 1) - lengths - 1
    # Position in the part of each edge's end: edges are relaxed in this order, all parts at once.
    part_of = np.repeat(np.arange(len(parts)), lengths + 1)
    depth = end - first[part_of[start]]
    order = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
    start, end, piece, depth = start[order], end[order], piece[order], depth[order]
    edges = np.searchsorted(depth, np.arange(1, int(lengths.max(initial=0)) + 2))
    last = np.full(len(points) + 1, NONE)
    source = np.full(len(points) + 1, NONE)
    is_first = np.zeros(len(points) + 1, bool)
    is_first[first] = True
    for a, b in zip(edges, edges[1:], strict=False):
        s, e, p = start[a:b], end[a:b], piece[a:b]
        fine = is_first[s]
        follow = np.flatnonzero(~fine & (last[s] >= 0))
        fine[follow] = allowed(v, last[s[follow]], p[follow])
        last[e[fine]], source[e[fine]] = p[fine], s[fine]
    # Back from the end of every part, all parts at once.
    at, who, steps = first + lengths, np.arange(len(parts)), []
    while len(who):
        steps.append((who, last[at]))
        at = source[at]
        on = at > first[who]
        at, who = at[on], who[on]
    owner = np.concatenate([w for w, _ in reversed(steps)]) if steps else np.zeros(0, np.int64)
    ids = np.concatenate([i for _, i in reversed(steps)]) if steps else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=len(parts))


def encode_batch(texts: list[str | None], model: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and the number of ids of each."""
    v = vocabulary(model)
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    joined = "".join(marked)
    if not joined:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    strange = ~v.known[points]
    cut = strange.copy()
    cut[1:] |= strange[:-1]
    if v.cuts_at_space:
        space = points == ord(SPACE)
        cut[1:] |= space[1:] & ~space[:-1]
    cut[starts] = True
    at = np.flatnonzero(cut)
    bounds = at.tolist() + [len(joined)]
    encoded = pa.array([joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], pa.string()).dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct: list[str] = encoded.dictionary.to_pylist()
    plain = np.fromiter((bool(v.known[ord(d[0])]) for d in distinct), bool, len(distinct))
    ids: list[np.ndarray] = [np.zeros(0, np.int64)]
    sizes = np.zeros(len(distinct), np.int64)
    if plain.any():
        flat, counts = encode_parts(v, [d for d, ok in zip(distinct, plain, strict=True) if ok])
        ids.append(flat)
        sizes[plain] = counts
    # Characters outside the vocabulary are their bytes.
    raw = [[v.byte_ids[b] for b in distinct[i].encode("utf-8", "surrogatepass")] for i in np.flatnonzero(~plain)]
    sizes[~plain] = [len(r) for r in raw]
    ids.append(np.array([i for r in raw for i in r], np.int64))
    flat = np.concatenate(ids)
    begin = np.zeros(len(distinct), np.int64)
    begin[plain] = np.cumsum(sizes[plain]) - sizes[plain]
    begin[~plain] = sizes[plain].sum() + np.cumsum(sizes[~plain]) - sizes[~plain]
    each = sizes[codes]
    place = np.cumsum(each) - each
    stream = flat[np.repeat(begin[codes] - place, each) + np.arange(int(each.sum()))]
    per_text = np.zeros(len(texts), np.int64)
    per_text[lengths > 0] = np.add.reduceat(each, np.searchsorted(at, starts))
    return stream, per_text


def decode_ids(ids, model: bytes) -> str:
    """The text of some ids; the space that encoding puts before a text goes."""
    v = vocabulary(model)
    raw = b"".join([v.out[i] for i in ids]).decode("utf-8", "replace")
    return raw[1:] if raw.startswith(" ") else raw


@functools.lru_cache(maxsize=2)
def piece_bytes(model: bytes) -> pa.Array:
    """The bytes of every id."""
    return pa.array(vocabulary(model).out, pa.binary())


def decode_lists(lists: pa.ListArray, model: bytes) -> list[str | None]:
    """`decode_ids` of many lists; a null list gives null.

    The pieces of all ids are taken at once and lie in one buffer, of which each text is a stretch.
    """
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    pieces = piece_bytes(model).take(lists.flatten())
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int32)
    buffer = memoryview(pieces.buffers()[2] or b"") if len(pieces) else memoryview(b"")
    cuts = ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    out = []
    for known, a, b in zip(lists.is_valid().to_pylist(), cuts, cuts[1:], strict=False):
        text = bytes(buffer[a:b]).decode("utf-8", "replace") if known else None
        out.append(text[1:] if text and text.startswith(" ") else text)
    return out


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, ids: the ids that the model's own library gives for each text.

    Null and empty texts have no ids. Repeated rows are encoded each for itself.
    The model is read on the driver and broadcast (its file is half a megabyte).
    """
    held = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "")
                if size > BATCH_CHARACTERS:
                    yield columns(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield columns(ids, texts)

    def columns(ids, texts):
        stream, counts = encode_batch(texts, held.value)
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return {"doc_id": ids, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(stream.astype(np.int32)))}

    return partition_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, ids array<int>")


def with_decoded(encoded_docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, ids, and the text that the ids decode to in `decoded`; null ids give a null text."""
    held = encoded_docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batch):
        yield {"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "decoded": decode_lists(batch.column("ids"), held.value)}

    return arrow_map(encoded_docs.select("doc_id", "ids"), run, "doc_id bigint, ids array<int>, decoded string")
