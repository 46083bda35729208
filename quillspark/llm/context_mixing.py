"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A token is coded as binary decisions along the path to the leaf that its hash names, then as a decision among the leaf's
words. Every decision is predicted by several contexts; weights that the contexts' confidence selects mix the predictions in
the logistic domain and learn from each token. The spelling of words that the corpus lacks is coded byte by byte in the same way.

What the corpus teaches is gathered over Spark's shuffle: counts of all words and, for every context of two words, the
continuation seen most often (both growing with the corpus; continuations are named by 32 bits, contexts in a bucket by 32, and words of one name share its probability); and bit counts of low orders, of a fixed size. Batches of documents send the
distinct keys they hold to hash buckets, as packed arrays; each bucket adds up what all batches send and answers each of them. So
no task and no broadcast holds a table that grows with the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.session import stored

#: The token that ends a text; no word holds a line end.
END = b"\n"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
SENT = "batch long, bucket long, kind int, payload binary"
#: Kinds of payloads: counts of words, continuations of contexts, sums of bit counts.
WORDS, CONTEXTS, SUMS = 0, 1, 2
WORD_BITS, WORD_MASK = np.uint64(32), np.uint64((1 << 32) - 1)


@dataclass(frozen=True)
class Shape:
    """Sizes and rates of the model.

    ``depth``: decisions to one of 2^depth leaves. ``slots``: log2 of the slots of each table of low-order bit counts; these
    tables, 4 of them, are all that is broadcast. ``start``: weights of the node's own frequency, orders 1 and 2, the
    document's own bits and the expected continuation. ``real``: the type that mixing computes in.
    """

    depth: int = 10
    slots: int = 16
    rate: float = 0.02
    local_rate: float = 0.25
    match_rate: float = 0.15
    start: tuple[float, ...] = (0.35, 0.3, 0.2, 0.25, 0.6)
    real: type = np.float32

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def slot(self, context: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Slot of a hashed context (uint32) at a node, given as ``spread_of`` it."""
        return ((context ^ spread) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - self.slots)


#: How likely the expected continuation is before a document says more: by times seen (1, 2-3, 4-15, more), where it was most of what followed and where not.
EXPECTED = np.array([0.6, 0.8, 0.9, 0.95, 0.2, 0.3, 0.35, 0.4])


def spread_of(node: np.ndarray) -> np.ndarray:
    return node.astype(np.uint32) * np.uint32(0x9E3779B1)


def hashes_of(words: list[bytes]) -> np.ndarray:
    """XXH64 with seed 42."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


def before(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value before each token, 0 where a document begins."""
    out = np.concatenate((values[:1], values[:-1]))
    out[first] = 0
    return out


def contexts(leaf: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the leaf before and of the two leaves before each token; first: where a document begins."""
    prior = before(leaf.astype(np.uint32) + np.uint32(1), first)
    second = before(prior, first)
    one = (prior + np.uint32(1)) * np.uint32(0xC2B2AE35)
    return one, (one ^ (second + np.uint32(7)) * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)


def pair_keys(hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit keys of the two words before each token."""
    prior = before(hashed, first)
    second = before(prior, first)
    key = (prior * np.uint64(0x9E3779B97F4A7C15)) ^ ((second + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys >> np.uint64(33)) % np.uint64(n)


def word_bucket(hashed: np.ndarray, n: int) -> np.ndarray:
    """Words that share the 32 bits by which continuations name them meet in one bucket."""
    low = hashed & WORD_MASK
    return (low ^ (low >> np.uint64(11))) % np.uint64(n)


def tokens_of(texts):
    """(words, ids, sizes) of an Arrow column of texts (null: empty): distinct tokens, their place for each token of each text in turn, the end included, and texts' numbers of tokens."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts))
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    held = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # blanks at an end leave empty strings
    place, owner = coded.indices.to_numpy()[held], np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[held]
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    ids = np.full(int(sizes.sum()), len(coded.dictionary), np.int32)
    ids[np.arange(len(place)) + owner] = place
    return pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())]), ids, sizes


# --- packed arrays ----------------------------------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed payload; ``unpacked`` gives them back."""
    import pyarrow as pa

    raw = [np.ascontiguousarray(x) for x in arrays]
    head = ";".join(f"{x.dtype.str},{len(x)}" for x in raw).encode()
    body = len(head).to_bytes(4, "little") + head + b"".join(x.tobytes() for x in raw)
    return len(body).to_bytes(8, "little") + pa.Codec("zstd").compress(body, asbytes=True)


def unpacked(payload: bytes) -> list[np.ndarray]:
    import pyarrow as pa

    body = pa.Codec("zstd").decompress(payload[8:], decompressed_size=int.from_bytes(payload[:8], "little"), asbytes=True)
    at = 4 + int.from_bytes(body[:4], "little")
    out = []
    for x in body[4:at].decode().split(";"):
        kind, n = x.split(",")
        out.append(np.frombuffer(body, kind, int(n), at))
        at += out[-1].nbytes
    return out


def steps(sorted_keys: np.ndarray) -> np.ndarray:
    """Differences of ascending keys; their running sum gives the keys back."""
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def by_bucket(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """(bucket, where it is) of an ascending array of buckets."""
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return [(int(bucket[a]), slice(int(a), int(b))) for a, b in zip(at, np.append(at[1:], len(bucket)), strict=True)]


# --- what a batch sends, and what comes back --------------------------------------------------------------------------


class Batch:
    """The tokens of some documents, their keys in the order in which they are sent, and where documents begin."""

    def __init__(self, table, shape: Shape, buckets: int) -> None:
        self.shape, self.buckets = shape, buckets
        self.words, self.ids, self.sizes = tokens_of(table["text"])
        self.training = ~table["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.learns = np.repeat(self.training, self.sizes)  # by token
        seen = np.flatnonzero(np.bincount(self.ids, minlength=len(self.words)))
        hashed = np.zeros(len(self.words), np.uint64)
        hashed[seen] = hashes_of(self.words.take(_indices(seen)).to_numpy(zero_copy_only=False).tolist())
        self.hashed, self.seen = hashed, seen[np.lexsort((hashed[seen], word_bucket(hashed[seen], buckets)))]
        self.leaf = (hashed & np.uint64(shape.leaves - 1)).astype(np.int32)
        self.by_token = self.leaf[self.ids]
        keys = pair_keys(hashed[self.ids], self.first)
        keys = (bucket_of(keys, buckets) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))  # a bucket tells its keys apart by 32 bits
        self.places, place_of = np.unique(keys, return_inverse=True)
        self.place_of = place_of.astype(np.int32)
        self.short = (hashed & WORD_MASK).astype(np.uint32)[self.ids]  # 32 bits of the word; the lowest name its leaf

    def sent(self):
        """(bucket, kind, payload): words with their training counts, contexts with their training continuations, sums of bit counts."""
        n = np.bincount(self.ids[self.learns], minlength=len(self.words))[self.seen]
        keys = self.hashed[self.seen]
        for bucket, at in by_bucket(word_bucket(keys, self.buckets)):
            yield bucket, WORDS, packed(steps(keys[at]), n[at])
        pairs, times = np.unique((self.place_of[self.learns].astype(np.uint64) << WORD_BITS) | self.short[self.learns].astype(np.uint64), return_counts=True)
        of = (pairs >> WORD_BITS).astype(np.int64)
        held = np.bincount(of, minlength=len(self.places))
        from_ = np.cumsum(held) - held
        for bucket, at in by_bucket(self.places >> np.uint64(32)):
            a, b = int(from_[at.start]), int(from_[at.stop - 1] + held[at.stop - 1])
            word = (pairs[a:b] & WORD_MASK).astype("<u4")
            keys32 = (self.places[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield bucket, CONTEXTS, packed(steps(keys32), held[at].astype(np.uint32), word, times[a:b].astype(np.uint32))
        yield int(self.places[0] % np.uint64(self.buckets)), SUMS, packed(self.bit_counts())  # any bucket will do

    def bit_counts(self) -> np.ndarray:
        """Training counts of bits: by node, by hashed order 1 and 2; then of the bytes of the training words by hashed order 1 and 2."""
        shape = self.shape
        counts = np.zeros((4, 2, 1 << shape.slots), np.int64)
        leaves = self.by_token[self.learns]
        sizes = self.sizes[self.training]
        hashed = contexts(leaves, np.cumsum(sizes) - sizes) if len(leaves) else ()
        for d in range(shape.depth if len(leaves) else 0):
            spread = spread_of((leaves | shape.leaves) >> (shape.depth - d))
            bit = (leaves >> (shape.depth - 1 - d) & 1).astype(np.uint32)
            for k, context in enumerate(hashed):
                self.add(counts[k], shape.slot(context, spread), bit)
        # A node's ones are what its right child sees; all nodes' counts come from those of the leaves.
        under = np.bincount(leaves | shape.leaves, minlength=2 * shape.leaves)
        for node in range(shape.leaves - 1, 0, -1):
            under[node] = under[2 * node] + under[2 * node + 1]
        nodes = np.stack((under[: shape.leaves], under[1::2]))
        nodes[:, 0] = 0  # no node
        known = np.flatnonzero(np.bincount(self.ids[self.learns], minlength=len(self.words)))
        byte, starts = spellings(self.words.take(_indices(known)))
        for d in range(8 if len(byte) else 0):
            node, bit = (byte | 256) >> (8 - d), (byte >> (7 - d) & 1).astype(np.uint32)
            for k, context in enumerate(contexts(byte, starts), 2):
                self.add(counts[k], shape.slot(context, spread_of(node)), bit)
        return np.concatenate((nodes.ravel(), counts.ravel()))

    def add(self, counts: np.ndarray, slot: np.ndarray, bit: np.ndarray) -> None:
        both = np.bincount(slot << np.uint32(1) | bit, minlength=2 << self.shape.slots).reshape(-1, 2)
        counts[0] += both.sum(axis=1)
        counts[1] += both[:, 1]


def _indices(at: np.ndarray):
    import pyarrow as pa

    return pa.array(at)


def spellings(words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of an Arrow array of words put together, each followed by a space, which no word holds."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ended = pc.binary_join_element_wise(words, pa.scalar(b"", pa.binary()), pa.scalar(b" ", pa.binary()))
    at = np.frombuffer(ended.buffers()[1], np.int32)[ended.offset : ended.offset + len(ended) + 1] if len(ended) else np.zeros(1, np.int32)
    raw = np.frombuffer(ended.buffers()[2], np.uint8)[at[0] : at[-1]] if len(ended) else np.zeros(0, np.uint8)
    return raw.astype(np.int64), (at[:-1] - at[0]).astype(np.int64)


def answered(batches: list[int], payloads: list[bytes], kind: int, shape: Shape) -> list[tuple[int, int, bytes]]:
    """(batch, kind, payload) for what all batches sent to one bucket; batch -1: for the model."""
    held = [unpacked(p) for p in payloads]
    if kind == SUMS:
        return [(-1, SUMS, packed(sum(x[0] for x in held)))]
    keys = [np.cumsum(x[0], dtype=x[0].dtype) for x in held]
    if kind == WORDS:
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.bincount(at, np.concatenate([x[1] for x in held]), len(every)).astype(np.int64)
        # Words of the corpus that continuations cannot tell apart share what is expected of their name by their counts.
        _, named = np.unique(every & WORD_MASK, return_inverse=True)
        part = np.log(np.maximum(c, 1) / np.maximum(np.bincount(named, c), 1)[named]).astype(np.float32) if len(every) else np.zeros(0, np.float32)
        out, begin = [], 0
        for batch, k in zip(batches, keys, strict=True):
            mine = at[begin : begin + len(k)]
            out.append((batch, WORDS, packed(c[mine], part[mine])))
            begin += len(k)
        leaf = (every & np.uint64(shape.leaves - 1)).astype(np.int64)
        return [*out, (-1, WORDS, packed(np.bincount(leaf, c, shape.leaves).astype(np.int64), np.bincount(leaf, c > 0, shape.leaves).astype(np.int64)))]
    pairs = np.concatenate([(np.repeat(k, x[1]).astype(np.uint64) << WORD_BITS) | x[2] for k, x in zip(keys, held, strict=True)])
    order = np.argsort(pairs)
    pairs, n = pairs[order], np.concatenate([x[3] for x in held]).astype(np.int64)[order]
    new = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
    n, pairs = np.add.reduceat(n, new) if len(new) else n, pairs[new]
    key, word = (pairs >> WORD_BITS).astype(np.uint32), (pairs & WORD_MASK).astype(np.uint32)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    names = key[starts]
    total, times = (np.add.reduceat(n, starts), np.maximum.reduceat(n, starts)) if len(key) else (n, n)
    # The word seen most often after each key, the smallest on ties: the first in the key's row that reaches the largest count.
    most = np.flatnonzero(n == np.repeat(times, np.diff(np.append(starts, len(key)))))
    top = word[most[np.searchsorted(most, starts)]] if len(key) else word
    out = []
    for batch, k in zip(batches, keys, strict=True):
        where = np.minimum(np.searchsorted(names, k), max(0, len(names) - 1))
        seen = names[where] == k if len(names) else np.zeros(len(k), bool)
        often = seen & (total[where] > 1) if len(names) else seen
        told = where[often]
        out.append((batch, CONTEXTS, packed(np.packbits(often), top[told], times[told], total[told])))
    return out


class Answers:
    """What a batch got back, in the order in which it sent: c by word, and part, the log of its part of the counts of its name; top, times and total by context (total 0: nothing to expect)."""

    def __init__(self, batch: Batch, rows: list[tuple[int, int, bytes]]) -> None:
        got = {(kind, bucket): unpacked(p) for kind, bucket, p in rows}
        self.c, self.part = np.zeros(len(batch.words), np.int64), np.zeros(len(batch.words), np.float32)
        for bucket, at in by_bucket(word_bucket(batch.hashed[batch.seen], batch.buckets)):
            self.c[batch.seen[at]], self.part[batch.seen[at]] = got[WORDS, bucket]
        n = len(batch.places)
        self.top, self.times, self.total = np.zeros(n, np.uint32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for bucket, at in by_bucket(batch.places >> np.uint64(32)):
            often, top, times, total = got[CONTEXTS, bucket]
            where = at.start + np.flatnonzero(np.unpackbits(often, count=at.stop - at.start))
            self.top[where], self.times[where], self.total[where] = top, np.minimum(times, 1 << 30), np.minimum(total, 1 << 30)


def expectations(batch: Batch, answers: Answers) -> tuple[np.ndarray, np.ndarray]:
    """(word, kind) that is expected at each token: the continuation seen most often after the two words before, and its place in ``EXPECTED``; kind -1 for none.

    A training document's own words do not count: what only it says is nothing to expect.
    """
    top, times, total = answers.top[batch.place_of], answers.times[batch.place_of], answers.total[batch.place_of]
    held = np.flatnonzero((total > 0) & batch.learns)
    doc = np.repeat(np.arange(len(batch.sizes)), batch.sizes)[held]
    own = doc * np.int64(len(batch.places)) + batch.place_of[held]
    names, at = np.unique(own, return_inverse=True)
    times[held] -= np.bincount(at, batch.short[held] == top[held], len(names)).astype(np.int32)[at]
    total[held] -= np.bincount(at, minlength=len(names)).astype(np.int32)[at]
    kind = ((times >= 2).astype(np.int8) + (times >= 4) + (times >= 16)) + np.where(2 * times.astype(np.int64) >= total, np.int8(0), np.int8(4))
    return top, np.where(times > 0, kind, np.int8(-1)).astype(np.int8)


# --- the model --------------------------------------------------------------------------------------------------------


class Model:
    """Logits of the trained low-order predictors, the gates their counts open, and the leaves' totals."""

    def __init__(self, shape: Shape, sums: np.ndarray, leaf_tokens: np.ndarray, leaf_words: np.ndarray) -> None:
        self.shape, self.tokens, self.words = shape, int(leaf_tokens.sum()), int(leaf_words.sum())
        nodes = sums[: 2 * shape.leaves].reshape(2, -1)
        held = sums[2 * shape.leaves :].reshape(4, 2, -1)
        logit = lambda seen, ones: np.log((ones + 0.4) / (seen - ones + 0.4)).clip(-12, 12).astype(shape.real)
        self.order0 = logit(*nodes)
        self.order1, self.order2, self.byte1, self.byte2 = (logit(*x) for x in held)
        sure = (held[:, 0] >= 32).astype(np.int8)
        self.gate1, self.gate2, self.byte_gate = sure[0], 2 * sure[1], sure[3]
        self.leaf_total = leaf_tokens + 0.5 * (leaf_words + 1)

    def log_tokens(self, leaf: np.ndarray, share: np.ndarray, sizes: np.ndarray, expected: np.ndarray, kind: np.ndarray, hit: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
        """Natural-log probability of each document's tokens.

        leaf, share: leaf of each token and log of its word's share of the leaf. expected, kind: leaf of the expected word and its place in ``EXPECTED`` (-1: none); hit: whether
        it is the token; part: log of the word's part of its name's counts (None: all of it). Documents run side by side, token by token. Five predictors give logits for each decision of
        the path: the node's own frequency, hashed orders 1 and 2, one that learns the document's bits, and the
        expected word as long as the path agrees with its own. Weights, chosen by the contexts' counts and by whether a word is expected, mix them
        and move by the gradient of the coding cost after every token. On the expected word's leaf one more decision says whether it is that word;
        otherwise the word costs its share of the leaf.
        """
        shape, real = self.shape, self.shape.real
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        one, two = contexts(leaf, begins)
        half = shape.depth // 2
        middle = spread_of((leaf | shape.leaves) >> (shape.depth - half))
        gate_of = self.gate1.take(shape.slot(one, middle)) + self.gate2.take(shape.slot(two, middle)) + 4 * (kind >= 0).astype(np.int8)
        lanes, gates, total = len(begins), 8, np.zeros(len(begins))
        weights = np.repeat(np.array(shape.start, real)[:, None], gates * lanes, axis=1)
        local = np.repeat(self.order0, lanes)
        # Logit of "the path goes on as expected" after d agreeing bits, and at the leaf.
        depth = np.arange(shape.depth + 1)
        right = EXPECTED[:, None] + (1 - EXPECTED[:, None]) * 0.5 ** (depth + 1)
        right[:, -1] = EXPECTED * 0.98
        reach = EXPECTED[:, None] + (1 - EXPECTED[:, None]) * 0.5**depth
        reach[:, -1] = 1
        trust = np.repeat(np.log(right / (reach - right)).astype(real).ravel(), lanes)
        lane_of, level = np.arange(lanes), np.arange(shape.depth)[:, None] * lanes
        down, bit_of = np.arange(shape.depth, 0, -1)[:, None], np.arange(shape.depth - 1, -1, -1)[:, None]
        live_at = np.searchsorted(-sizes, -np.arange(sizes[0] if lanes else 0), side="left")
        rate, local_rate, match_rate, least, most = map(real, (shape.rate, shape.local_rate, shape.match_rate, 1 / 65536, 1 - 1 / 65536))
        spreads, inputs = spread_of(np.arange(shape.leaves)), np.zeros((5, shape.depth, lanes), real)
        for t, live in enumerate(live_at.tolist()):
            at, lane, x = begins[:live] + t, lane_of[:live], inputs[:, :, :live]
            to, sort = leaf.take(at).astype(np.int64), kind.take(at).astype(np.int64)
            path = (to | shape.leaves) >> down
            bit = (to >> bit_of) & 1
            up = bit.astype(real)
            spread = spreads.take(path)
            own = path * lanes + lane
            x[0] = self.order0.take(path)
            x[1] = self.order1.take(shape.slot(one.take(at), spread))
            x[2] = self.order2.take(shape.slot(two.take(at), spread))
            x[3] = local.take(own)
            some = np.flatnonzero(sort >= 0)
            x[4] = 0
            if len(some):
                awaited = expected.take(at[some]).astype(np.int64)
                agrees = ((to[some] ^ awaited) >> down) == 0
                of = sort[some] * ((shape.depth + 1) * lanes) + some
                of = of + level
                held = trust.take(of)
                toward = awaited >> bit_of & 1
                x[4][:, some] = np.where(agrees, np.where(toward, held, -held), real(0))
                of, held, hits = of[agrees], held[agrees], (toward == bit[:, some])[agrees]
                trust[of] = held + match_rate * (hits - 1 / (1 + np.exp(-held)))
            gate = gate_of.take(at).astype(np.int64) * lanes + lane
            w = weights[:, gate]
            dot = w[0] * x[0]
            for a, b in zip(w[1:], x[1:], strict=True):
                dot += a * b
            np.exp(np.negative(dot, out=dot), out=dot)
            dot += 1
            p = np.minimum(np.maximum(np.reciprocal(dot, out=dot), least), most)
            off = up - p
            cost = np.log(1 - np.abs(off)).sum(axis=0, dtype=np.float64)
            weights[:, gate] = w + rate * np.einsum("dl,kdl->kl", off, x)
            local[own] = x[3] + local_rate * (up - 1 / (1 + np.exp(-x[3])))
            cost += share.take(at)
            if len(some) and (reached := some[to[some] == awaited]).size:
                where = sort[reached] * ((shape.depth + 1) * lanes) + shape.depth * lanes + reached
                q, is_it, whole = trust.take(where), hit.take(at[reached]), share.take(at[reached])
                p = 1 / (1 + np.exp(-q))
                sure = np.minimum(np.maximum(p, least), most).astype(np.float64)
                cost[reached] += np.where(is_it, np.log(sure) + (0 if part is None else part.take(at[reached])) - whole, np.log1p(-sure))
                trust[where] = q + match_rate * (is_it - p)
            total[:live] += cost
        out = np.empty(lanes)
        out[order] = total
        return out

    def log_spelling(self, byte: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural-log probability of each document's unknown words' bytes. starts: where words begin. Hashed orders 1 and 2 inside the word, and the document's own bits after the byte before, are mixed as tokens are."""
        shape, real = self.shape, self.shape.real
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        one, two = contexts(byte, starts)
        lanes, gates, total = len(begins), 2, np.zeros(len(begins))
        weights = [np.full(gates * lanes, x, real) for x in (0.3, 0.6, 0.3)]
        local = np.zeros(256 * lanes, real)
        lane_of, down, bit_of = np.arange(lanes), np.arange(8, 0, -1)[:, None], np.arange(7, -1, -1)[:, None]
        live_at = np.searchsorted(-sizes, -np.arange(sizes[0] if lanes else 0), side="left")
        rate, local_rate, least, most = map(real, (shape.rate, shape.local_rate, 1 / 65536, 1 - 1 / 65536))
        for t, live in enumerate(live_at.tolist()):
            at, lane = begins[:live] + t, lane_of[:live]
            to = byte[at]
            path, bit = (to | 256) >> down, (to >> bit_of & 1).astype(real)
            spread = spread_of(path)
            s1, s2, own = shape.slot(one[at], spread), shape.slot(two[at], spread), path * lanes + lane
            inputs = (self.byte1.take(s1), self.byte2.take(s2), local.take(own))
            gate = self.byte_gate.take(s2).astype(np.int64)
            dot = sum(w.take(gate * lanes + lane) * x for w, x in zip(weights, inputs, strict=True))
            off = bit - np.minimum(np.maximum(1 / (1 + np.exp(-dot)), least), most)
            total[:live] += np.log((1 - np.abs(off)).astype(np.float64).prod(axis=0))
            where = (gate * live + lane).ravel()
            for w, x in zip(weights, inputs, strict=True):
                w.reshape(gates, lanes)[:, :live] += (rate * np.bincount(where, (off * x).ravel(), gates * live).reshape(gates, live)).astype(real)
            local[own] = inputs[2] + local_rate * (bit - 1 / (1 + np.exp(-inputs[2])))
        out = np.empty(lanes)
        out[order] = total
        return out


def score_batch(docs, answers: list[tuple[int, int, bytes]], model: Model, buckets: int):
    """Scores of a batch of documents, given what came back for its keys as (kind, bucket, payload)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    batch = Batch(docs, model.shape, buckets)
    got = Answers(batch, answers)
    ids, sizes, n_docs = batch.ids, batch.sizes, len(batch.sizes)
    owner = np.repeat(np.arange(n_docs), sizes)
    c = got.c
    base = np.log10((c + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
    share = np.log((c + 0.5) / model.leaf_total[batch.leaf]).astype(model.shape.real)
    top, kind = expectations(batch, got)
    hit = (kind >= 0) & (top == batch.short) & (c[ids] > 0)  # a word that the corpus lacks is nothing that it could expect
    awaited = (top & np.uint32(model.shape.leaves - 1)).astype(np.int32)
    del top
    score = model.log_tokens(batch.by_token, share[ids], sizes, awaited, kind, hit, got.part[ids]) / np.log(10)
    unknown = np.flatnonzero(c[ids] == 0)
    byte, starts = spellings(batch.words.take(_indices(ids[unknown])))
    lengths = np.bincount(owner[unknown], np.diff(np.append(starts, len(byte))), n_docs).astype(np.int64)
    spelled = np.zeros(n_docs)
    some = lengths > 0
    if some.any():
        spelled[some] = model.log_spelling(byte, lengths[some], starts)
    n_bytes = pc.fill_null(pc.binary_length(docs["text"]), 0).to_numpy()
    columns = {
        "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array(sizes), "n_known": pa.array(np.bincount(owner, c[ids] > 0, n_docs).astype(np.int64)),
        "train_tokens": pa.array(np.full(n_docs, model.tokens)), "base_score": pa.array(np.bincount(owner, base[ids], n_docs)), "score": pa.array(score),
        "bits_per_byte": pa.array(-(score * np.log2(10) + spelled / np.log(2)) / np.maximum(1, n_bytes)),
    }
    return pa.table(columns)


def totals(answers: DataFrame, shape: Shape) -> list[np.ndarray]:
    """(bit counts, tokens by leaf, words by leaf) out of the rows for the model: summed up in each task, then by slices of 1024 numbers."""
    lengths = {SUMS: 2 * shape.leaves + (8 << shape.slots), WORDS: 2 * shape.leaves}

    def partial(batches):
        import pyarrow as pa

        held = {k: np.zeros(n, np.int64) for k, n in lengths.items()}
        for b in batches:
            for kind, payload in zip(b["kind"].to_pylist(), b["payload"].to_pylist(), strict=True):
                held[kind] += np.concatenate(unpacked(payload))
        for kind, sums in held.items():
            parts = -(-len(sums) // 1024)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(parts, kind, np.int32)), pa.array(np.arange(parts, dtype=np.int32)), pa.array([sums[1024 * k : 1024 * k + 1024].tobytes() for k in range(parts)], pa.binary())], ["kind", "part", "sums"]
            )

    def add(table):
        import pyarrow as pa

        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table["sums"])
        return table.slice(0, 1).set_column(2, "sums", pa.array([total.tobytes()], pa.binary()))

    told = "kind int, part int, sums binary"
    parts = answers.where("batch < 0").select("kind", "payload").mapInArrow(partial, told).groupBy("kind", "part").applyInArrow(add, told).collect()
    out = {k: np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r.sums, np.int64) for r in sorted(parts, key=lambda r: r.part) if r.kind == k]]) for k in lengths}
    out = {k: x if len(x) else np.zeros(lengths[k], np.int64) for k, x in out.items()}
    return [out[SUMS], out[WORDS][: shape.leaves], out[WORDS][shape.leaves :]]


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = None, batch_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row for each row of ``docs``.

    Tokens are words lower-cased in A-Z, then one end. The model learns from all rows outside ``held_out``. base_score is that of the
    unigram model with 0.5 added; score is the mixed model's log10 probability of the text's tokens, words without a training count being
    one token as they are there, with a share of 0.5 counts of their leaf. bits_per_byte also counts the spelling of those words. Of what follows
    two words, a training document's score does not use what only the document itself says. A row's score
    depends on the trained model and its own text only; weights and the document's own predictor go on through the whole text.

    Documents are dealt by hash into batches of about ``batch_bytes``, those of one doubling of length among themselves,
    so that a batch's documents end at about the same time. Buckets of keys grow in number with the text. The low-order tables, of a size set by ``shape``, are broadcast.

    Null text counts as empty (one token, the end); null ids are never held out; repeated rows repeat.
    Without training rows all probabilities come from what is added. An empty table gives no rows. Other columns are ignored.
    """
    shape = shape or Shape()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    length = F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16, F.lit(512).cast("long"))  # a document's state takes some 4 KB, however short it is
    rows = rows.withColumn("likes", F.greatest(F.lit(0), F.ceil(F.log2(length / 2048))).cast("int"))
    held = {r.likes: r.bytes for r in rows.groupBy("likes").agg(F.sum(length).alias("bytes")).collect()}  # a row for each doubling of length
    counts = {k: -(-n // batch_bytes) for k, n in sorted(held.items())}
    starts = {k: sum(n for j, n in counts.items() if j < k) for k in counts}
    buckets = max(1, sum(held.values()) // (2 * batch_bytes))
    of = lambda d: F.element_at(F.create_map(*[F.lit(x) for pair in d.items() for x in pair]), F.col("likes")) if d else F.lit(1)
    rows = rows.withColumn("batch", (F.pmod(F.xxhash64(F.lit(9), "doc_id", F.crc32("text")), of(counts)) + of(starts)).cast("long")).drop("likes")

    def send(table):
        import pyarrow as pa

        batch = table["batch"][0].as_py()
        sent = [*Batch(table, shape, buckets).sent()]
        return pa.table({"batch": pa.array([batch] * len(sent), pa.int64()), "bucket": pa.array([x[0] for x in sent], pa.int64()), "kind": pa.array([x[1] for x in sent], pa.int32()), "payload": pa.array([x[2] for x in sent], pa.binary())})

    def answer(table):
        import pyarrow as pa

        bucket, kind = table["bucket"][0].as_py(), table["kind"][0].as_py()
        told = answered(table["batch"].to_pylist(), table["payload"].to_pylist(), kind, shape)
        return pa.table({"batch": pa.array([x[0] for x in told], pa.int64()), "bucket": pa.array([bucket] * len(told), pa.int64()), "kind": pa.array([x[1] for x in told], pa.int32()), "payload": pa.array([x[2] for x in told], pa.binary())})

    answers = stored(rows.groupBy("batch").applyInArrow(send, SENT).groupBy("kind", "bucket").applyInArrow(answer, SENT))
    model = docs.sparkSession.sparkContext.broadcast(Model(shape, *totals(answers, shape)))

    def score(documents, told):
        import pyarrow as pa

        pa.default_memory_pool().release_unused()  # of the batch before
        return score_batch(documents, [*zip(told["kind"].to_pylist(), told["bucket"].to_pylist(), told["payload"].to_pylist(), strict=True)], model.value, buckets)

    return rows.groupBy("batch").cogroup(answers.where("batch >= 0").groupBy("batch")).applyInArrow(score, SCORED)
