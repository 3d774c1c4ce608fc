"""Set similarity join of texts on word n-grams: the classes of texts that links of Jaccard similarity connect.

Method: token-combination prefixes. A text's tokens (hashes of its n-grams) are put in an order that is the same for all
texts: rare ones first. If two sets are similar, at most ``slack = n - ceil(threshold * n)`` tokens of either are missing in
the other. Take tokens in that order until they cover ``slack + 1``: a token of the rare class covers 1; tokens of a
frequent class cover one less than there are of them, because they are indexed as pairs. By counting, one rare token or one pair
of the same frequent class is then common to both prefixes, so texts without a common index key are not similar.

Steps, each a Spark job over all rows:

1. every text gets its set's size and fingerprint; equal sets are one class from here on (a map task passes the tokens of
   a set it has seen no second time);
2. tokens are counted; those of one class only can never be an index key, so nothing of them is kept but their number.
   Sets of a size of 100 or more use the half of all tokens with an even hash: what is missing in the other set is
   still at most ``slack``. Sizes are dealt with level by level, a set near a border belongs to both levels, and a set of
   which the halving left too few tokens also goes to the level that uses all of them, as does any set
   that can be similar to it. Nothing is lost;
3. the index: prefix keys, each key's smallest set as its centre, a link from every set of the key to the centre. The
   connected components of these candidate links are the groups that can hold similar sets;
4. verification by exact intersection: every set of a group against the group's first block, then blocks against blocks,
   in groups of more than one block, unless a pair of blocks is already of one class or too different in size;
5. connected components of the verified links.

Tokens that many texts share are found in a sample of texts (``hot_tokens``); the sample decides only over how many tasks their
rows are dealt and that they come last in the order, not which rows take part.

Defined cases: a null or empty text, or one without words, has the empty set and is linked with nothing; a text with
fewer words than n has one token, its whole word sequence; repeated rows are of one class; a row without a key is a class of
its own with its texts' equals, the class id is the smallest key that is not null; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmill.llm.common import arrow, settle, spread_join
from wordmill.llm.components import components
from wordmill.llm.hashed import BLANK, distinct, grams, mix, runs, words
from wordmill.operators.scale import numbered

U = np.uint64
#: Lower ends of the levels of set sizes; each frequent class of a level is one of so many.
LEVELS = (0, 100, 400, 1600, 6400, 25600, 102400, 409600)
CLASSES = (1, 4, 16, 64, 256, 1024, 4096, 16384)


@dataclass(frozen=True)
class Settings:
    n: int = 4
    #: Two sets link when 100 * intersection >= percent * union.
    percent: int = 85
    #: Tokens of more sets than this are of the frequent class.
    frequent: int = 32
    #: Sets of a block of the verification.
    block: int = 128
    #: One of so many texts is looked at for hot tokens, and the share of these that makes a token hot.
    one_of: int = 64
    share: float = 0.02

    def slack(self, n: np.ndarray | int) -> np.ndarray | int:
        return n - (self.percent * n + 99) // 100


# ---- tokens


def sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each row and their rows, by row and token."""
    hashes, rows, _, _ = words(data, offsets, BLANK)
    found, owner, _ = grams(hashes, rows, tuple(range(n)), n)
    short = np.flatnonzero((np.bincount(rows, minlength=len(offsets) - 1) < n)[rows]) if len(rows) else np.zeros(0, np.int64)
    if len(short):  # the whole sequence of a short text is one token
        own, first = np.unique(rows[short], return_index=True)
        size = np.diff(np.append(first, len(short)))
        whole = np.full(len(own), U(1))
        for step in range(n - 1):
            has = size > step
            whole[has] = mix(whole[has] * U(0x9E3779B97F4A7C15) + hashes[short][first[has] + step])
        found, owner = np.concatenate([found, whole]), np.concatenate([owner, own])
    return distinct(found, owner)


def prints(tokens: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and size of each row's set; 0 for the empty set."""
    size = np.bincount(rows, minlength=n)
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(tokens + U(0xD6E8FEB86659FD93)))])
    end = np.cumsum(size)
    made = mix(total[end] - total[end - size] + size.astype(U) * U(0xA0761D6478BD642F))
    return np.where(size > 0, made, U(0)).view(np.int64), size


def level_of(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, size, "right") - 1


def dealt(tokens: np.ndarray, rows: np.ndarray, size: np.ndarray, s: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Level, places of tokens in it, and tokens under the level's own hash, for each level that rows belong to.

    Sets that cannot be similar to another one than their equals are left out: those for which even the largest set that can be
    similar to them has no slack. A set without slack of its own may be part of a larger one that has some.
    """
    slack, most = s.slack(size), s.slack(size * 100 // s.percent)
    level = level_of(size)
    half = (tokens & U(1)) == 0
    kept = np.bincount(rows[half], minlength=len(size))
    classes = np.array(CLASSES)[level]
    below = (s.percent * size + 99) // 100 < np.array(LEVELS)[level]
    # a set with so few kept tokens, or one that can be similar to such a set, also goes to the level of all tokens
    thin = (level > 0) & ((kept <= slack + classes) | (kept - slack <= s.slack(size * 100 // s.percent + 1) + classes))
    for k in range(len(LEVELS)):
        member = (most > 0) & ((level == k) | (below & (level == k + 1)) | ((k == 0) & thin))
        if member.any():
            at = np.flatnonzero(member[rows] & (half | (k == 0)))
            yield k, at, mix(tokens[at] + U(k + 1))


# ---- index keys


def keys(counts: np.ndarray, tokens: np.ndarray, need: int, level: int, s: Settings) -> np.ndarray:
    """Index keys of one set: of its shared tokens, given how many rows have each; they have to cover ``need``."""
    if need <= 0:
        return np.zeros(0, U)
    order = np.lexsort((tokens, counts))
    counts, tokens = counts[order], tokens[order]
    rare = int((counts <= s.frequent).sum())
    if rare >= need:
        return tokens[:need]
    kind = (tokens[rare:] >> U(40)) % U(CLASSES[level])
    repeat = np.ones(len(kind), bool)
    repeat[np.unique(kind, return_index=True)[1]] = False
    cover = np.cumsum(repeat)
    end = int(np.searchsorted(cover, need - rare)) + 1
    often, kind = tokens[rare : rare + end], kind[:end]
    pairs = [tokens[:rare]]
    for k in np.unique(kind):
        mine = often[kind == k]
        i, j = np.triu_indices(len(mine), 1)
        pairs.append(mix(np.minimum(mine[i], mine[j]) * U(0x9FB21C651E98DF25) + np.maximum(mine[i], mine[j])))
    return np.concatenate(pairs)


# ---- verification


def links(ids: np.ndarray, size: np.ndarray, tokens: np.ndarray, pivots: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """Links that join similar sets, without those between sets already joined; pivots are compared with all sets."""
    start = np.cumsum(size) - size
    names, at = np.unique(tokens, return_inverse=True)
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, mask = [], np.zeros(len(names), np.int32)
    for p in pivots:
        mine = at[start[p] : start[p] + size[p]]
        mask[mine] = 1
        both = np.add.reduceat(mask[at], start)
        mask[mine] = 0
        near = 100 * both >= s.percent * (size + size[p] - both)
        for i in np.flatnonzero(near):
            a, b = root(int(i)), root(int(p))
            if a != b:
                parent[a] = b
                out.append((int(ids[i]), int(ids[p])))
    return out


def _verified(rows: DataFrame, by: list[str], s: Settings) -> DataFrame:
    """Links within groups of sets (set, tokens, pivot), each group of two blocks at most."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["set"].to_numpy()
        tokens = [np.frombuffer(x, U) for x in table["tokens"].to_pylist()]
        size = np.array([len(x) for x in tokens], np.int64)
        found = links(ids, size, np.concatenate(tokens), np.flatnonzero(table["pivot"].to_numpy(zero_copy_only=False)), s) if table.num_rows > 1 else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy(*by).applyInArrow(run, "a long, b long")


def fingerprints(plain: DataFrame, s: Settings) -> DataFrame:
    """(key, set, n) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, to, data, offsets in runs(batch["text"]):
                mark, size = prints(*sets(data, offsets, s.n), to - at)
                made.append(mark)
                sizes.append(size)
            yield pa.record_batch([batch["key"], pa.array(np.concatenate(made)), pa.array(np.concatenate(sizes))], ["key", "set", "n"])

    return arrow(plain, run, "key long, set long, n long")


def hot_tokens(plain: DataFrame, s: Settings) -> np.ndarray:
    """Tokens of a large share of a sample of the texts; there are at most (tokens of a text) / share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in runs(batch["text"]):
                tokens, rows = sets(data, offsets, s.n)
                for _, _, named in dealt(tokens, rows, np.bincount(rows, minlength=to - at), s):
                    yield pa.record_batch([pa.array(named.view(np.int64))], ["token"])

    sampled = plain.where(F.pmod(F.xxhash64("key"), F.lit(s.one_of)) == 0)
    least = max(16, int(sampled.count() * s.share))
    counts = arrow(sampled, run, "token long").groupBy("token").count()
    return np.sort(np.array([r["token"] for r in counts.where(F.col("count") >= least).select("token").collect()], np.int64))


def shared_tokens(plain: DataFrame, hot: np.ndarray, s: Settings) -> DataFrame:
    """(set, level, gap, found): the tokens of each set that other sets have too, with their counts; ``gap`` is the
    number of all its tokens on the level less what they have to cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for at, to, data, offsets in runs(batch["text"]):
                tokens, rows = sets(data, offsets, s.n)
                mark, size = prints(tokens, rows, to - at)
                new = np.zeros(to - at, bool)
                new[np.unique(mark, return_index=True)[1]] = True
                new &= ~np.isin(mark, seen)
                seen = np.concatenate([seen, mark[new]])
                tokens, rows = tokens[new[rows]], rows[new[rows]]
                for k, place, named in dealt(tokens, rows, np.where(new, size, 0), s):
                    owner, named = rows[place], named.view(np.int64)
                    gap = np.bincount(owner, minlength=to - at) - s.slack(size) - 1
                    often = np.isin(named, hot)
                    salt = np.where(often, mark[owner] % 251 + 1, 0).astype(np.int16)
                    columns = [pa.array(named), pa.array(mark[owner]), pa.array(np.full(len(named), k, np.int8)), pa.array(gap[owner].astype(np.int32)), pa.array(salt)]
                    yield pa.record_batch(columns, ["token", "set", "level", "gap", "salt"])

    spread = Window.partitionBy("token", "salt")
    most = F.lit(2**31 - 1)
    tokens = arrow(plain, run, "token long, set long, level tinyint, gap int, salt smallint")
    counted = tokens.withColumn("count", F.count("*").over(spread)).withColumn("shared", F.min("set").over(spread) < F.max("set").over(spread))
    shared = counted.where("shared OR salt > 0").withColumn("count", F.when(F.col("salt") > 0, most).otherwise(F.least("count", most)).cast("int"))
    return shared.groupBy("set", "level").agg(F.first("gap").alias("gap"), F.collect_set(F.struct("count", "token")).alias("found"))


def index(lists: DataFrame, s: Settings) -> DataFrame:
    """(key, set): the index keys of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_, levels, gaps, found = batch["set"].to_pylist(), batch["level"].to_pylist(), batch["gap"].to_pylist(), batch["found"]
            counts, tokens = (found.flatten().field(i).to_numpy() for i in (0, 1))
            at = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())])
            out, owner = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for i, mine in enumerate(sets_):
                part = slice(at[i], at[i + 1])
                made = keys(counts[part], tokens[part].view(U), int(at[i + 1] - at[i]) - gaps[i], levels[i], s)
                out.append(made)
                owner.append(np.full(len(made), mine))
            yield pa.record_batch([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(owner))], ["key", "set"])

    return arrow(lists, run, "key long, set long")


def candidates(keyed: DataFrame) -> DataFrame:
    """(set, group): the connected components of the sets that have an index key in common."""
    centre = keyed.groupBy("key").agg(F.min("set").alias("a"), F.max("set").alias("last")).where("a < last").select("key", "a")
    found = keyed.join(centre, "key").where("set <> a").select("a", F.col("set").alias("b")).distinct()
    return components(found).select(F.col("node").alias("set"), F.col("root").alias("group"))


NO_KEY = -(2**63)
#: Bits of the filter with which tasks pass by rows of no group; fixed, so what is sent to them is 1 MB at most.
FILTER_BITS, BITMAP = 1 << 23, 1 << 15


def with_tokens(plain: DataFrame, groups: DataFrame, s: Settings) -> DataFrame:
    """(set, group, n, tokens) for every set of a group; ``groups`` has (set, group, n, rep)."""
    bit = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))
    marked = groups.select(bit.alias("bit")).groupBy(F.expr(f"cast(bit div {BITMAP} as int)").alias("part"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in marked.agg(F.bitmap_construct_agg((F.col("bit") % BITMAP).cast("long")).alias("bits")).collect():
        bits[row["part"] * (BITMAP // 8) : (row["part"] + 1) * (BITMAP // 8)] = np.frombuffer(row["bits"], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch["bit"].to_numpy()
            batch = batch.filter(pa.array((bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))
            for at, to, data, offsets in runs(batch["text"]):
                tokens, rows = sets(data, offsets, s.n)
                mark, size = prints(tokens, rows, to - at)
                end = np.cumsum(size)
                yield pa.record_batch([pa.array(mark), pa.array([tokens[b - n : b].tobytes() for b, n in zip(end, size, strict=True)], pa.binary())], ["set", "tokens"])

    near = plain.select("text", F.pmod(F.xxhash64(F.coalesce("key", F.lit(NO_KEY))), F.lit(FILTER_BITS)).alias("bit"))
    made = arrow(near, run, "set long, tokens binary")
    return made.join(groups.select("set", "group", "n"), "set").groupBy("set", "group", "n").agg(F.first("tokens").alias("tokens"))


def verified(held: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between similar sets of a group: as many as it takes to connect them, not all."""
    count = held.groupBy("group").agg(F.count("*").alias("size"))
    large = settle(count.where(F.col("size") > s.block), "large")
    small = held.join(large.select("group"), "group", "left_anti").select("group", "set", "tokens", F.lit(0).cast("long").alias("chunk"), F.lit(True).alias("pivot"))

    def blocks(rows: DataFrame, order: list) -> DataFrame:
        return numbered(rows, order, ["group"], "place", 0).withColumn("chunk", F.expr(f"place div {s.block}"))

    members = held.select("group", "set", "n").join(large, "group")
    first = settle(blocks(members, [F.col("n"), F.col("set")]).select("group", "set", "chunk", "size"), "blocks")
    again = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {s.block}")))
    pivots = first.where("chunk = 0").select("group", "set", again.alias("chunk"), F.lit(True).alias("pivot"))
    others = first.where("chunk > 0").select("group", "set", "chunk", F.lit(False).alias("pivot"))
    tokens = held.select("set", "tokens")
    star = pivots.unionByName(others).join(tokens, "set").select("group", "set", "tokens", "chunk", "pivot")
    one = settle(_verified(small.unionByName(star), ["group", "chunk"], s), "links")
    if large.isEmpty():
        return one
    joined = components(one)
    members = members.join(joined.withColumnRenamed("node", "set"), "set", "left").select("group", "set", "n", F.coalesce("root", "set").alias("root"))
    second = settle(blocks(members, [F.col("root"), F.col("n"), F.col("set")]), "blocks")
    facts = second.groupBy("group", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("root").alias("root"), (F.min("root") < F.max("root")).alias("mixed"))
    body = facts.where("NOT mixed").groupBy("group", "root").agg(F.count("*").alias("many")).groupBy("group").agg(F.max_by("root", F.struct("many", "root")).alias("body"))
    facts = settle(facts.join(body, "group", "left").withColumn("in_body", F.coalesce(~F.col("mixed") & (F.col("root") == F.col("body")), F.lit(False))), "facts")
    side = lambda x, rows: rows.select("group", *[F.col(c).alias(f"{c}_{x}") for c in ("chunk", "lo", "hi", "root", "mixed", "in_body")])
    meet = side("a", facts.where("NOT in_body")).join(side("b", facts), "group").where("in_body_b OR chunk_a <= chunk_b")
    meet = meet.where("CASE WHEN chunk_a = chunk_b THEN mixed_a ELSE mixed_a OR mixed_b OR root_a <> root_b END")
    meet = meet.where((F.col("lo_a") * s.percent <= F.col("hi_b") * 100) & (F.col("lo_b") * s.percent <= F.col("hi_a") * 100))
    meet = settle(meet.select("group", "chunk_a", "chunk_b"), "meet")
    sides = meet.select("group", "chunk_a", "chunk_b", F.col("chunk_a").alias("chunk"), F.lit(True).alias("pivot")).unionByName(
        meet.where("chunk_a <> chunk_b").select("group", "chunk_a", "chunk_b", F.col("chunk_b").alias("chunk"), F.lit(False).alias("pivot"))
    )
    rows = second.select("group", "chunk", "set").join(sides, ["group", "chunk"]).join(tokens, "set")
    two = _verified(rows.select("group", "chunk_a", "chunk_b", "set", "tokens", "pivot"), ["group", "chunk_a", "chunk_b"], s)
    return settle(one.unionByName(two), "links")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """One row per row: key, n_shingles, component_id (smallest key of its class)."""
    s = settings or Settings()
    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    told = settle(fingerprints(plain, s), "sets")
    lists = settle(shared_tokens(plain, hot_tokens(plain, s), s), "shared")
    groups = candidates(settle(index(lists, s), "keys"))
    sizes = told.groupBy("set").agg(F.max("n").alias("n"), F.min(F.coalesce("key", F.lit(NO_KEY))).alias("rep"), F.min("key").alias("low"), F.count("*").alias("rows"))
    sizes = settle(sizes, "sizes")
    held = settle(with_tokens(plain, settle(groups.join(sizes.select("set", "n", "rep"), "set"), "groups"), s), "held")
    roots = components(verified(held, s)).withColumnRenamed("node", "set")
    # classes are settled on different sets; what they say goes to the sets of large classes, and to the rows of large groups of copies, by salted joins
    low = F.when(F.col("n") > 0, F.col("low")).alias("low")
    known = settle(sizes.join(roots, "set", "left").select("set", "rows", low, F.coalesce("root", "set").alias("class")), "known")
    smallest = settle(known.groupBy("class").agg(F.min("low").alias("component_id"), F.count("*").alias("many")), "smallest")
    named = spread_join(known.select("set", "rows", "class"), smallest, ["class"], "many")
    full = spread_join(told, settle(named.select("set", "rows", "component_id"), "named"), ["set"], "rows")
    return full.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


SQL = """
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
    s AS (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END) AS t FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS MATERIALIZED (
        SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
    r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id AND r.root < l.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""
