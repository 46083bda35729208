"""Phrase collocations from a weighted de Bruijn graph of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.llm.common import lean_worker
from quillspark.session import stored

LONGEST = 4
#: 0: part of a word, 1: a blank between words, 2: an end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
#: kind: the number of words, and 8 for each leading word down to which the phrase may go on in other ranges.
EDGES = "range int, kind int, lang string, phrase string, n long"


def tokens(texts):
    """(code of each word, distinct words, its document, words left in its piece from it on) of an Arrow array of texts, A-Z in lower case. Words are never Python objects."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = KIND[raw]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(raw)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    at = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - at
    if not len(at):
        return np.zeros(0, np.int64), pa.array([], pa.string()), at, at
    piece, doc = np.searchsorted(np.flatnonzero(kind == 2), at), np.searchsorted(ends, at, side="right") - 1
    fresh = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])))
    upto = np.append(fresh[1:], len(at))
    left = np.repeat(upto, upto - fresh) - np.arange(len(at))
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw[inside])).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, doc, left


def counted(codes: np.ndarray, n_words: int, langs: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(langs, words, counts) of the distinct longest grams of two words or more that begin at each word: up to LONGEST words, fewer at the end of a piece. words: a row of codes + 1 each, 0 where none."""
    base = n_words + 1
    padded = np.concatenate((codes + 1, np.zeros(LONGEST, np.int64)))
    at = np.flatnonzero(left > 1)
    word = lambda j: np.where(left[at] > j, padded[at + j], 0)
    front, fronts = np.unique((langs[at] * base + word(0)) * base + word(1), return_inverse=True)
    back, backs = np.unique(word(2) * base + word(3), return_inverse=True)
    pairs, counts = np.unique(fronts * max(1, len(back)) + backs, return_counts=True)
    front, back = front[pairs // max(1, len(back))], back[pairs % max(1, len(back))]
    return front // base // base, np.stack((front // base % base, front % base, back // base, back % base), axis=1), counts


def hashes(words) -> np.ndarray:
    """A number over 0 for each of an Arrow array of words (none empty), the same everywhere: a polynomial of its bytes, mixed. Words that share one lie in one range, no more."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    heads, sizes = ends[:-1] - ends[0], np.diff(ends)
    powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    x = np.add.reduceat(raw * powers[np.arange(len(raw)) - np.repeat(heads, sizes)], heads)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31)) | np.uint64(1)


class Ranges:
    """Ranges of grams in the order of their words' hashes, first word first: grams of equal first words lie side by side. ``bounds``: rows of hashes of a gram's words (0: none), where ranges begin."""

    def __init__(self, bounds: np.ndarray) -> None:
        self.known = np.unique(bounds[bounds > 0])
        self.begins = np.unique(self.keys(self.places(bounds)))
        self.edges = np.concatenate((np.full(1, 2**64 - 1, np.uint64), self.begins, np.full(1, 2**64 - 1, np.uint64)))

    def places(self, hashed: np.ndarray) -> np.ndarray:
        """Where each hash lies among the bounds' own ones: odd places are between them, 0 is for no word."""
        at = np.searchsorted(self.known, hashed)
        equal = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == hashed) if len(self.known) else np.zeros(hashed.shape, bool)
        return np.where(hashed == 0, 0, 2 * at + 1 + equal).astype(np.uint64)

    @staticmethod
    def keys(places: np.ndarray) -> np.ndarray:
        return np.bitwise_or.reduce(places << (np.arange(LONGEST)[::-1] * 16).astype(np.uint64), axis=1)

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range, open): open is the largest number of leading words that a bound beside the gram shares with it; only phrases of so many words or fewer go on in other ranges."""
        keys = self.keys(places)
        at = np.searchsorted(self.begins, keys, side="right")
        unlike = np.minimum(keys ^ self.edges[at], keys ^ self.edges[at + 1])
        return at, sum((unlike < np.uint64(1 << bits)).astype(np.int32) for bits in (48, 32, 16)) + (unlike == 0)


def slices(batch, most: int) -> Iterator:
    """``batch`` (lang, text) in slices of about ``most`` bytes of text."""
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def edges(rows: DataFrame, ranges: Ranges, batch_bytes: int, most_singles: int = 500_000) -> DataFrame:
    """EDGES of ``rows`` (lang, text): counts of a slice of texts. Of each position the longest gram is told; besides, of each word its count, and under the empty phrase the number of all words, which a task adds up over slices."""

    def told(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        lean_worker()
        turn = TaskContext.get().partitionId() % (len(ranges.begins) + 1)
        table = lambda *columns: pa.Table.from_arrays(list(columns), schema=pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())]))
        same = lambda value, n: pa.array(np.full(n, value, np.int32))
        singles, held = [], 0
        for batch in batches:
            for part in slices(batch, batch_bytes):
                codes, words, doc, left = tokens(part.column("text"))
                if not len(codes):
                    continue
                coded = part.column("lang").dictionary_encode()
                langs = coded.indices.to_numpy().astype(np.int64)[doc]
                in_lang, grams, counts = counted(codes, len(words), langs, left)
                single, times = np.unique(langs * len(words) + codes, return_counts=True)
                everything, totals = np.unique(langs, return_counts=True)
                del codes, doc, left, langs
                places = np.append(np.zeros(1, np.uint64), ranges.places(hashes(words)))
                at, opened = ranges.of(places[grams])
                named = pa.concat_arrays([pa.array([None], pa.string()), words])
                phrase = pc.binary_join_element_wise(*(named.take(pa.array(grams[:, j])) for j in range(LONGEST)), " ", null_handling="skip")
                yield from table(pa.array(at.astype(np.int32)), pa.array((8 * opened + (grams > 0).sum(axis=1)).astype(np.int32)), coded.dictionary.take(pa.array(in_lang)), phrase, pa.array(counts)).to_batches(max_chunksize=65_536)
                del in_lang, grams, counts, at, opened, phrase
                alone = np.zeros((len(words), LONGEST), np.uint64)
                alone[:, 0] = places[1:]
                at = ranges.of(alone)[0].astype(np.int32)[single % len(words)]
                singles.append(table(pa.array(at), same(1, len(at)), coded.dictionary.take(pa.array(single // len(words))), words.take(pa.array(single % len(words))), pa.array(times)))
                singles.append(table(same(turn, len(totals)), same(0, len(totals)), coded.dictionary.take(pa.array(everything)), pa.array([""] * len(totals), pa.string()), pa.array(totals)))
                held += len(at)
                if held > most_singles:
                    met = pa.concat_tables(singles).group_by(["range", "kind", "lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["range", "kind", "lang", "phrase", "n"])
                    singles, held = [met], met.num_rows
                    if held > most_singles // 2:
                        yield from met.to_batches(max_chunksize=65_536)
                        singles, held = [], 0
                pa.default_memory_pool().release_unused()
        if singles:
            met = pa.concat_tables(singles).group_by(["range", "kind", "lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["range", "kind", "lang", "phrase", "n"])
            yield from met.to_batches(max_chunksize=65_536)
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(told, EDGES)


def bounds(rows: DataFrame, share: float, rate: float, ranges: int, batch_bytes: int) -> np.ndarray:
    """Where ``ranges`` ranges of about equally many distinct grams begin, by a part ``rate`` of the grams of a sample of ``rows``. Where they lie changes no count."""
    names = [f"w{j}" for j in range(LONGEST)]

    def told(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lean_worker()
        for batch in batches:
            for part in slices(batch, batch_bytes):
                codes, words, _, left = tokens(part.column("text"))
                grams = counted(codes, len(words), np.zeros(len(codes), np.int64), left)[1]
                hashed = np.append(np.zeros(1, np.uint64), hashes(words))[grams]
                drawn = np.bitwise_xor.reduce(hashed * np.arange(3, 3 + 2 * LONGEST, 2, dtype=np.uint64), axis=1) >> np.uint64(32)
                hashed = hashed[drawn <= np.uint64(rate * (2**32 - 1))].view(np.int64)
                yield from pa.Table.from_arrays([pa.array(hashed[:, j]) for j in range(LONGEST)], names=names).to_batches(max_chunksize=65_536)

    drawn = rows.sample(share, 7).mapInArrow(told, ", ".join(f"{c} long" for c in names))
    grams = drawn.toPandas().to_numpy(np.int64).reshape(-1, LONGEST).view(np.uint64)
    grams = grams[np.lexsort(grams.T[::-1])]
    return grams[np.unique(np.arange(1, ranges) * len(grams) // ranges)] if len(grams) else grams


def words_in(phrase: Column) -> Column:
    return F.char_length(phrase) - F.char_length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def first_words(phrase: Column, n: int) -> Column:
    return F.substring_index(phrase, " ", n)


def frequent(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang", ranges: int = 4096, part_bytes: int = 8 << 20, batch_bytes: int = 10 << 20,
             sample_docs: int = 2000, sample_grams: int = 1 << 16) -> DataFrame:
    """(lang, phrase, f): every phrase of up to four words that occurs ``least`` times in its language within pieces, and under the empty phrase the number of all words.

    The graph's nodes are three words in a row, its edges four. A task counts, for each word of some texts, the longest gram that begins there: an edge, or at the end of a piece what
    is left of it. These counts alone are shuffled. A node's flow is the sum of the edges that leave it and the ends of pieces there; two words have
    the flow of the nodes that begin with them, and the ends there. So an edge's count is added to all its prefixes of two words or more where it arrives.

    Counts arrive by ranges of grams, in which equal beginnings lie side by side: a phrase's flow is complete in its range, unless the range begins or ends inside of it. Only such phrases and frequent ones
    are added up across ranges. Two words that a third of all text repeats spread over many ranges, since the grams that they begin are distinct rows. Where the ranges begin is
    drawn from a sample of about ``sample_docs`` documents and ``sample_grams`` grams; it changes no count.
    """
    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    share = min(1.0, sample_docs / max(1, n))
    cut = Ranges(bounds(rows, share, min(1.0, 8 * sample_grams / max(1.0, share * (size or 0))), ranges, batch_bytes))  # a gram for each 8 bytes, at most about
    dealt = edges(rows, cut, batch_bytes).repartition(max(1, -(-(size or 0) // part_bytes)), "range")
    k, levels = F.col("kind").bitwiseAND(7), lambda *js: F.array(*map(F.lit, js))
    flows = dealt.withColumn("j", F.explode(F.when(k == 4, levels(2, 3, 4)).when(k == 3, levels(2, 3)).when(k == 2, levels(2)).when(k == 1, levels(1)).otherwise(levels(0))))
    flows = flows.select("range", "lang", "n", F.when(F.col("j") == k, F.col("phrase")).otherwise(F.expr("substring_index(phrase, ' ', j)")).alias("phrase"), (F.shiftright("kind", 3) >= F.col("j")).alias("shared"))
    flows = flows.groupBy("range", "lang", "phrase").agg(F.sum("n").alias("f"), F.max("shared").alias("shared"))
    whole = flows.where((F.col("f") >= least) | F.col("shared")).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return whole.where((F.col("f") >= least) | (F.col("phrase") == ""))


def last_words(phrase: Column, n: int) -> Column:
    return F.substring_index(phrase, " ", -n)


def passages(counts: DataFrame) -> DataFrame:
    """(lang, phrase, passage, f): for each edge of ``counts`` (``frequent``) the unary path that it lies on, as one text, and the path's flow.

    A node is unary if all its flow comes in by one edge and goes out by one: their counts equal its own. Edges that meet there are one path. Each edge finds the last edge of its path by pointer
    doubling, in as many rounds as the logarithm of the longest path; every path has an end, since pieces have. The frequent edges of one path then meet as one row.
    """
    edge = counts.where(words_in(F.col("phrase")) == LONGEST)
    node = counts.where(words_in(F.col("phrase")) == LONGEST - 1).select("lang", F.col("phrase").alias("node"), "f")
    out = edge.select("lang", F.col("phrase").alias("next"), first_words(F.col("phrase"), LONGEST - 1).alias("node"), "f")
    unary = node.join(out, ["lang", "node", "f"])
    chain = edge.withColumn("node", last_words(F.col("phrase"), LONGEST - 1)).join(unary, ["lang", "node", "f"], "left")
    chain = stored(chain.select("lang", "phrase", "f", F.coalesce("next", "phrase").alias("end"), F.col("next").isNotNull().cast("long").alias("steps")))
    while True:
        far = chain.select("lang", F.col("phrase").alias("end"), F.col("end").alias("beyond"), F.col("steps").alias("more"))
        moved = stored(chain.join(far, ["lang", "end"]).select("lang", "phrase", "f", F.col("beyond").alias("end"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")))
        chain = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    paths = chain.groupBy("lang", "end").agg(F.reverse(F.sort_array(F.collect_list(F.struct("steps", "phrase")))).alias("path"))
    text = F.concat_ws(" ", F.get("path", F.lit(0))["phrase"], F.transform(F.slice("path", 2, F.greatest(F.lit(1), F.size("path"))), lambda e: last_words(e["phrase"], 1)))
    return chain.join(paths.select("lang", "end", text.alias("passage")), ["lang", "end"]).select("lang", "phrase", "passage", "f")


def exact(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to four words by how strongly their words hold together.

    Texts fall into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs, A-Z in lower case. a: the phrase's occurrences, ``least`` or more; l, r: those of its two parts
    where it is cut; score: floor(2000000 * a / (l + r)) at its weakest cut, the first of equals; n: all words of the language. A phrase goes if a longer one around it
    occurs at least ``inside`` percent as often: inner nodes of unary paths at once, as the edges beside them occur just as often, others by comparison. Counts are exact (``frequent``), products are decimals.

    Null texts and texts without words give no phrases, a null language counts as ``und``; repeated rows count each. A language without phrases has no rows; an empty table
    gives none. Words of any length count whole. Other columns are ignored, whatever their names.
    """
    counts = stored(frequent(docs, least, text_col, lang_col, **how).withColumn("k", F.when(F.col("phrase") == "", 0).otherwise(words_in(F.col("phrase")))))
    part = lambda name, f: counts.where(F.col("k").between(1, LONGEST - 1)).select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = counts.where("k >= 2").withColumnRenamed("f", "a").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"front": F.expr("substring_index(phrase, ' ', cut)"), "back": F.expr("substring_index(phrase, ' ', cut - k)")})
    cuts = cuts.join(part("front", "l"), ["lang", "front"]).join(part("back", "r"), ["lang", "back"])
    cuts = cuts.withColumn("score", F.expr("CAST(2000000 * CAST(a AS DECIMAL(19,0)) AS DECIMAL(38,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))").cast("long"))
    scored = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("weakest")).select("lang", "phrase", "k", "a", "weakest.*")
    # Unary nodes: one edge brings all the flow, one takes it.
    edge = counts.where(F.col("k") == LONGEST)
    met = lambda words: edge.select("lang", words(F.col("phrase"), LONGEST - 1).alias("phrase"), F.col("f").alias("a"))
    scored = scored.join(met(last_words).intersect(met(first_words)), ["lang", "phrase", "a"], "left_anti")
    within = lambda j: F.expr(f"transform(sequence(0, k - {j}), i -> substring_index(substring_index(phrase, ' ', i + {j}), ' ', -{j}))")
    longer = counts.where("k >= 3").select("lang", "f", F.explode(F.array_distinct(F.concat(within(2), F.when(F.col("k") > 3, within(3)).otherwise(F.array())))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    swallowed = 100 * exact(F.col("around")) >= inside * exact(F.col("a"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(swallowed, F.lit(False)))
    sizes = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked(kept.drop("around", "k", "cut"), top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def ranked(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank: rows are sorted by ranges, and a range's ranks begin where those before it end, so no language is one task's work."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = stored(phrases.repartitionByRange("lang", *order).withColumn("range", F.spark_partition_id()))
    before = W.partitionBy("lang").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    begins = spread.groupBy("lang", "range").agg(F.count("*").alias("rows")).select("lang", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier")).where(F.col("earlier") < top)
    placed = spread.join(begins, ["lang", "range"]).withColumn("rank", (F.row_number().over(W.partitionBy("lang", "range").orderBy(*order)) + F.col("earlier")).cast("long"))
    return placed.where(F.col("rank") <= top).drop("range", "earlier")


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS ws FROM p
), g AS MATERIALIZED (
  SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(ws) >= k)
  GROUP BY ALL
), c AS MATERIALIZED (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 30
), h AS MATERIALIZED (
  SELECT lang, phrase, k, a, h, array_to_string(ws[1:h], ' ') AS front, array_to_string(ws[h + 1:k], ' ') AS back FROM c, (VALUES (1), (2), (3)) AS v(h) WHERE h < k
), s AS (
  SELECT h.lang, h.phrase, h.k, a, h, x.f AS l, y.f AS r, 2000000 * a // (x.f + y.f) AS score
  FROM h JOIN g AS x ON x.lang = h.lang AND x.phrase = front JOIN g AS y ON y.lang = h.lang AND y.phrase = back
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) = 1
), i AS (
  SELECT lang, array_to_string(ws[o:o + j - 1], ' ') AS phrase, max(a) AS around
  FROM c, (VALUES (2), (3)) AS v(j), (VALUES (1), (2), (3)) AS u(o) WHERE j < k AND o + j - 1 <= k GROUP BY ALL
), n AS (
  SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang
), t AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
  FROM b JOIN n ON n.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE around IS NULL OR 100 * around < 80 * a
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t WHERE rank <= 2000
"""
