"""Word-substitution maps. Every map is a table ``(src, dst)`` with one row per source word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.functions import fixed
from wordmill.functions.hashing import hash_int, hash_key
from wordmill.functions.text import norm_lev, utf8_length
from wordmill.operators.near import CELL_WORDS, LONGEST, by_forms, form_pairs
from wordmill.operators.scale import is_small, numbered, settle, task_count
from wordmill.operators.vocab import coarse_buckets, freq_rank, frequency_order
from wordmill.operators.wordpiece import wordpieces

THRESHOLD = 0.3
#: Greedy matching: words before a word with distances as columns, first words of a block that meet the words left over by
#: the block before, and how far apart these may stand to be compared.
LAGS, HEAD, NEAR = 4, 32, 8
#: Pairs that one task compares for a common segment.
TASK_PAIRS = 1 << 22
#: Rows of the segment index that one task holds.
INDEX_ROWS = 500_000


def lev_pairs(pairs: DataFrame, first: str = "src", second: str = "dst") -> DataFrame:
    """Normalised edit distance of every given pair, in both directions."""
    one = pairs.select(F.col(first).alias("a"), F.col(second).alias("b"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.withColumn("dist", norm_lev("a", "b"))


def near_words(vocab: DataFrame, max_dist: float = THRESHOLD) -> DataFrame:
    """Pairs of words one edit and at most ``max_dist`` of the longer length apart, both directions and each word with itself.

    Two such words share the word itself or a form with one letter left out, so the pairs come from an
    equi-join on those forms. Words too short for one edit within ``max_dist`` have no such forms and meet
    only themselves; a form is then shared by at most (alphabet size x length) words.
    """
    n = F.length("token")
    without = lambda i: F.concat(
        F.substring(F.col("token"), F.lit(1), i - 1), F.substring(F.col("token"), i + 1, n)
    )
    shorter = F.when(1 / n <= max_dist, F.transform(F.sequence(F.lit(1), n), without))
    forms = vocab.where(n > 0).select(
        "token",
        F.explode_outer(
            F.array_distinct(
                F.concat(F.array("token"), F.coalesce(shorter, F.array().cast("array<string>")))
            )
        ).alias("form"),
    )
    left = forms.select("form", F.col("token").alias("a"))
    right = forms.select("form", F.col("token").alias("b"))
    close = F.levenshtein(F.col("a"), F.col("b"), 1)
    near = left.join(right, "form").where(close >= 0).select("a", "b").distinct()
    return near.select("a", "b", norm_lev("a", "b").alias("dist")).where(F.col("dist") <= max_dist)


def near_pairs(vocab: DataFrame, max_dist: float = THRESHOLD, task_pairs: int = TASK_PAIRS, cell_words: int = CELL_WORDS) -> DataFrame:
    """All pairs of words at most ``max_dist`` of the longer length apart, both directions and each word with itself.

    A longer word may have k = floor(max_dist * its length) edits. Cut the shorter one into k + 1 segments: counting the
    edits of an optimal alignment from the left, some segment i stands unchanged in the longer word with at most i edits
    before it and k - i behind it. Only the places that this allows are looked up, in an equi-join on lengths, segment and
    text, and a hit is verified outwards from the segment: the letters of both sides first, then their edit distances within i and
    k - i. A pair is told at its first verified hit, so no pair is shuffled. Segments with more than ``task_pairs`` hits are
    split over several tasks. Rows per word grow with the square of its length.

    Segments of short words are short and shared by very many; pairs whose longer word is short enough are found by ``form_pairs`` instead.
    """
    size = F.char_length("token")
    tokens = settle(vocab.select("token", size.alias("size")).where("size > 0").distinct(), "words")
    lengths = settle(tokens.select("size").distinct(), "lengths")
    short = sorted(r["size"] for r in lengths.where(F.col("size") <= LONGEST).collect() if by_forms(r["size"], max_dist))
    k = F.floor(F.lit(max_dist) * F.col("size") + 1e-9).cast("int")
    shorter = F.explode(F.sequence(F.greatest(F.lit(1), F.col("size") - F.col("k")), "size"))
    longer_words = lengths.where(~F.col("size").isin(short)) if short else lengths
    cuts = longer_words.withColumn("k", k).where("k > 0").select(F.col("size").alias("longer"), "k", shorter.alias("size"))
    cuts = settle(cuts.join(lengths, "size", "left_semi"), "cuts")
    each = F.explode(F.sequence(F.lit(0), "k")).alias("i")
    key = lambda at: F.concat_ws(":", "size", "k", "i", F.substring(F.col("token"), at + 1, _after() - _first()))
    index = tokens.join(cuts.select("size", "k").distinct(), "size").select("token", "size", "k", each)
    index = index.select(key(_first()).alias("key"), F.col("token").alias("b"))
    places = tokens.withColumnRenamed("size", "longer").join(cuts, "longer").select("token", "longer", "size", "k", each)
    over = F.col("longer") - F.col("size")
    places = places.withColumn("place", F.explode(F.sequence(*_places(over, _first(), _after(), F.col("k"), F.col("i"), F.col("longer")))))
    probes = places.select(key(F.col("place")).alias("key"), F.col("token").alias("a"), F.col("place").cast("int"))
    index, probes, tasks = _split_heavy(index, probes, task_pairs)
    by = ["key", "salt"]
    index = _sides(index.repartition(tasks, *by), "b", None).drop("size", "k", "i")
    probes = _sides(probes.repartition(tasks, *by), "a", F.col("place"))
    within = lambda x, most: (F.bit_count(F.expr(f"{x}_a & ~{x}_b")) <= most) & (F.bit_count(F.expr(f"{x}_b & ~{x}_a")) <= most)
    longer, edits = F.char_length("a"), F.col("k") - F.col("i")
    hits = probes.join(index.hint("merge"), by).where(within("left", F.col("i")) & within("right", edits))
    hits = hits.where((longer > F.col("size")) | (F.col("a") < F.col("b")))
    verified = hits.where(_near("before_a", "before_b", F.col("i")) & _near("behind_a", "behind_b", edits))
    first = ~F.exists(
        F.sequence(F.lit(0), "i"),
        lambda j: F.exists(
            _possible(_places(longer - F.col("size"), _first(j), _after(j), F.col("k"), j, longer)),
            lambda q: ((j < F.col("i")) | (q < F.col("place"))) & _verified(j, q, F.col("k"), F.col("size")),
        ),
    )
    near = verified.where(first).select("a", "b", norm_lev("a", "b").alias("dist"))
    if short:
        near = near.unionByName(form_pairs(tokens, short, max_dist, cell_words).select("a", "b", (F.col("edits") / F.col("n")).alias("dist")))
    both = near.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("pair"), "dist")
    return tokens.select(F.col("token").alias("a"), F.col("token").alias("b"), F.lit(0.0).alias("dist")).unionByName(both.select("pair.a", "pair.b", "dist"))


def _first(i: Column | None = None) -> Column:
    """First place (from 0) of segment i of a word of ``size`` letters cut into k + 1."""
    return F.floor((F.col("i") if i is None else i) * F.col("size") / (F.col("k") + 1)).cast("int")


def _after(i: Column | None = None) -> Column:
    return _first((F.col("i") if i is None else i) + 1)


def _places(over: Column, first: Column, after: Column, k: Column, i: Column, longer: Column) -> tuple[Column, Column]:
    """First and last place of a segment in a word that is ``over`` letters longer; none if the last lies before the first."""
    low = F.greatest(F.lit(0), first - i, first + over - (k - i))
    high = F.least(first + i, first + over + (k - i), longer - (after - first))
    return low, high


def _possible(places: tuple[Column, Column]) -> Column:
    low, high = places
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _near(x: Column | str, y: Column | str, most: Column) -> Column:
    return F.call_function("levenshtein", x, y, most.cast("int")) >= 0


def _verified(i: Column, place: Column, k: Column, size: Column) -> Column:
    """Whether segment i of ``b`` stands at a place of ``a``, with at most i edits before it and k - i behind it."""
    first, after = _first(i), _after(i)
    same = F.substring("a", place + 1, after - first) == F.substring("b", first + 1, after - first)
    before = _near(F.substring("a", F.lit(1), place), F.substring("b", F.lit(1), first), i)
    behind = _near(F.substring("a", place + after - first + 1, F.char_length("a")), F.substring("b", after + 1, size), k - i)
    return same & before & behind


def _split_heavy(index: DataFrame, probes: DataFrame, task_pairs: int) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with a salt, and the number of tasks: a key with very many pairs has several salts.

    The number of tasks follows the pairs and the rows of the index, of which a task holds its share.
    """
    n = index.groupBy("key").agg(F.count("*").alias("n"))
    counts = settle(n.join(probes.groupBy("key").agg(F.count("*").alias("m")), "key"), "counts")
    rows, pairs = counts.agg(F.sum("n"), F.sum(F.col("n") * F.col("m"))).first()
    tasks = max(task_count(index.sparkSession), (rows or 0) // INDEX_ROWS, (pairs or 0) // (8 * task_pairs))
    parts = F.ceil(F.col("n") * F.col("m") / task_pairs).cast("int")
    heavy = settle(counts.where(F.col("n") * F.col("m") > task_pairs).select("key", parts.alias("parts")), "heavy")
    known = F.broadcast(heavy) if is_small(heavy) else heavy
    of = F.coalesce("parts", F.lit(1))
    salted = index.join(known, "key", "left").withColumn("salt", F.pmod(F.xxhash64("b"), of).cast("int"))
    copied = probes.join(known, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), of - 1)))
    return salted.drop("parts"), copied.drop("parts"), tasks


def _sides(rows: DataFrame, word: str, place: Column | None) -> DataFrame:
    """Rows with size, k and i from their key, what stands before and behind the segment, and the letters of both.

    Letters are bits, one for the first time of a letter and one for any further; within n edits at most n letters of
    either word are missing in the other.
    """
    field = lambda at: F.split_part("key", F.lit(":"), F.lit(at)).cast("int")
    rows = rows.withColumns({"size": field(1), "k": field(2), "i": field(3)})
    place = _first() if place is None else place
    before, behind = F.substring(word, F.lit(1), place), F.substring(word, place + _after() - _first() + 1, F.char_length(word))
    rows = rows.withColumns({f"before_{word}": before, f"behind_{word}": behind})
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bit = lambda c, at: F.when(c == "", none).otherwise(F.call_function("shiftleft", one, F.ascii(c) % 32 + at))
    add = lambda m, c: m.bitwiseOR(F.when(m.bitwiseAND(bit(c, 0)) == 0, bit(c, 0)).otherwise(bit(c, 32)))
    letters = lambda x: F.aggregate(F.split(x, ""), none, add)
    return rows.withColumns({f"left_{word}": letters(f"before_{word}"), f"right_{word}": letters(f"behind_{word}")})


def swap_rank(vocab: DataFrame, thr: float = THRESHOLD, by: str = "n_pieces") -> DataFrame:
    """Frequency-matched swap: neighbours in the frequency order of their group exchange places.

    Pairs that are too similar are ranked again among themselves and paired one step shifted; what is
    still unpaired or too similar keeps its place.
    """

    def paired(ranked: DataFrame, shift: int) -> DataFrame:
        at = F.floor((F.col("rank") - shift) / 2)
        groups = ranked.groupBy(by, at.alias("pair")).agg(
            F.min_by(F.struct("token", "freq"), "rank").alias("lo"),
            F.max_by(F.struct("token", "freq"), "rank").alias("hi"),
            F.count("*").alias("n"),
        )
        a, b = F.col("lo.token"), F.col("hi.token")
        return groups.withColumn("ok", (F.col("n") == 2) & (norm_lev(a, b) > thr)).withColumns(
            {"a": a, "b": b}
        )

    first = settle(paired(freq_rank(vocab.select("token", "freq", by), [by]), 1), "pairs")
    refused = first.where("n = 2 and not ok").select(by, F.explode(F.array("lo", "hi")).alias("w"))
    again = freq_rank(refused.select("w.token", "w.freq", by), [by])
    good = first.where("ok").select("a", "b").unionByName(paired(again, 0).where("ok").select("a", "b"))
    return _complete(vocab, _both_ways(good))


def swap_greedy(
    vocab: DataFrame,
    thr: float = THRESHOLD,
    by: str = "n_pieces",
    forms: str | None = None,
    block: int = 4096,
) -> DataFrame:
    """Frequency-matched swap, greedy: in frequency order, each word takes the first free word that is
    different enough (and, with ``forms``, shares no lemma form); a word that finds none maps to itself.

    The rule is symmetric, so taking the first free word both ways is the same as letting each word, in
    order, pair with the first earlier word that is still single. Only the few single words travel along
    the order, and nearly always they are gone after a few words. So a block of consecutive ranks has two
    ways to go: no word reaches it, or one that pairs with its first word. Both walks are made for all blocks at once;
    what leaves a block in each of them meets the first words of the next block, which tells after how many
    words the next block follows which of its two walks. These steps compose like functions of two values, so
    the walk that a block really takes comes from one window over the blocks, and the number of Spark jobs does not depend on
    their number. If on that way some words travel on past the first words of a block, the blocks are
    walked again from there until their states agree (``_walk_on``). Distances are columns; only
    words that stay single past ``LAGS`` others in a block are compared in the walk.
    """
    ranked = freq_rank(vocab, [by]).withColumn("block", F.floor((F.col("rank") - 1) / block))
    form_col = F.col(forms) if forms else F.lit(None).cast("array<string>")
    words = settle(ranked.select(by, "block", "rank", "token", form_col.alias("forms")), "words")
    kind = vocab.schema[by].dataType.simpleString()
    walked = settle(_with_lags(words, by, thr).groupBy(by, "block").applyInPandas(_two_walks(by, thr), _WALKED.format(by=by, kind=kind)), "walks")
    steps = settle(_steps(words, walked, by, kind, thr), "steps")
    # a step maps the walk of a block to the walk of the next one: a constant, the same, or the other
    order = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.col("to0") & ~F.col("to1")
    counted = steps.withColumn("turns", F.coalesce(F.sum(turned.cast("int")).over(order), F.lit(0)))
    fixed_ = F.last(F.when(F.col("to0") == F.col("to1"), F.struct(F.col("to0").alias("to"), "turns")), ignorenulls=True).over(order)
    before = counted.withColumn("fixed", fixed_)
    mode = F.coalesce("fixed.to", F.lit(False)) != ((F.col("turns") - F.coalesce("fixed.turns", F.lit(0))) % 2 == 1)
    taken = settle(before.withColumn("second", mode), "taken")
    if not taken.where(~F.when(F.col("second"), F.col("ok1")).otherwise(F.col("ok0"))).isEmpty():
        return _walk_on(vocab, words, thr, by)
    # the first words of the next block as the single words met them, and from there on its own walk
    side = lambda c: F.when(F.col("second"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    met = taken.select(by, (F.col("block") + 1).alias("block"), side("at").alias("at"), side("pairs").alias("met"))
    chosen = taken.select(by, "block", "second").join(met, [by, "block"], "left")
    own = walked.join(chosen, [by, "block"]).where((F.col("second") == F.col("later")) & (F.col("place") >= F.coalesce("at", F.lit(0))))
    pairs = own.where("partner IS NOT NULL").select(F.col("token").alias("a"), F.col("partner").alias("b"))
    pairs = pairs.unionByName(met.select(F.explode("met").alias("p")).select("p.a", "p.b"))
    return _complete(vocab, _both_ways(settle(pairs, "pairs")))


_WALKED = "{by} {kind}, block bigint, later boolean, place int, token string, forms array<string>, partner string, single boolean, free boolean"


def _with_lags(words: DataFrame, by: str, thr: float) -> DataFrame:
    """Words with, for each of the ``LAGS`` words before them in their block, whether the two may pair."""
    order = Window.partitionBy(by, "block").orderBy("rank")
    lagged = words.withColumns({f"t{d}": F.lag("token", d).over(order) for d in range(1, LAGS + 1)} | {f"f{d}": F.lag("forms", d).over(order) for d in range(1, LAGS + 1)})
    may = F.array(*[F.coalesce(_unrelated("token", "forms", f"t{d}", f"f{d}", thr), F.lit(False)) for d in range(1, LAGS + 1)])
    return lagged.withColumn("may", may).select(by, "block", "rank", "token", "forms", "may")


def _two_walks(by: str, thr: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Walks of one block from no single word, and from one that pairs with its first word.

    One row for each pair (at its later word), each word left over (``single``) and each of the first ``HEAD`` words at
    which no word is single before it (``free``).
    """

    def walks(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", ignore_index=True)
        tokens, shapes, may = group["token"].tolist(), group["forms"].tolist(), group["may"].tolist()
        rows = []
        for later in (False, True):
            single: list[int] = []
            for i in range(int(later), len(tokens)):
                free = not single and i < HEAD
                partner = None
                for at, j in enumerate(single):
                    if may[i][i - j - 1] if i - j <= LAGS else _different(_word(tokens, shapes, i), _word(tokens, shapes, j), thr):
                        partner = tokens[j]
                        del single[at]
                        break
                else:
                    single.append(i)
                if free or partner is not None:
                    rows.append((later, i, tokens[i], None, partner, False, free))
            if not single and len(tokens) < HEAD:
                rows.append((later, len(tokens), None, None, None, False, True))
            rows += [(later, j, tokens[j], shapes[j], None, True, False) for j in single]
        out = pd.DataFrame(rows, columns=["later", "place", "token", "forms", "partner", "single", "free"])
        out[by], out["block"] = group[by].iloc[0], group["block"].iloc[0]
        return out[[by, "block", "later", "place", "token", "forms", "partner", "single", "free"]]

    return walks


def _word(tokens: list[str], shapes: list, i: int) -> tuple:
    return (i, tokens[i], None if shapes[i] is None else frozenset(shapes[i]))


def _steps(words: DataFrame, walked: DataFrame, by: str, kind: str, thr: float) -> DataFrame:
    """For each block, after either of its walks: the walk of the next block, from which of its words on, and the pairs before.

    ``ok`` is false if words are still single after the first ``HEAD`` words of the next block.
    """
    order = Window.partitionBy(by, "block").orderBy("rank")
    head = words.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < HEAD)
    left = walked.where("single").select(by, (F.col("block") + 1).alias("block"), F.col("later").alias("of"), F.col("place").alias("from"), F.col("token").alias("other"), F.col("forms").alias("other_forms"))
    first = head.select(by, "block", "place", "token", "forms")
    # the words that leave a block, and the first words of the next among themselves, as far as a block's singles go
    reached = left.join(first, [by, "block"]).withColumn("may", _unrelated("token", "forms", "other", "other_forms", thr))
    ask = reached.select(by, "block", F.struct("of", "from", "other", "place", "token", "may").alias("x"))
    inner = first.alias("x").join(first.alias("y"), (F.col(f"x.{by}").eqNullSafe(F.col(f"y.{by}"))) & (F.col("x.block") == F.col("y.block")) & (F.col("x.place") < F.col("y.place")) & (F.col("y.place") <= F.col("x.place") + NEAR))
    inner = inner.join(left.select(F.col(by).alias("_by"), F.col("block").alias("_block")).distinct(), F.col(f"x.{by}").eqNullSafe(F.col("_by")) & (F.col("x.block") == F.col("_block")), "left_semi")
    own = inner.select(F.col(f"x.{by}").alias(by), F.col("x.block").alias("block"), F.struct(F.lit(None).cast("boolean").alias("of"), F.col("x.place").alias("from"), F.col("x.token").alias("other"), F.col("y.place").alias("place"), F.col("y.token").alias("token"), _unrelated("x.token", "x.forms", "y.token", "y.forms", thr).alias("may")).alias("x"))
    asked = ask.unionByName(own).groupBy(by, "block").agg(F.collect_list("x").alias("may"))
    free = walked.where("free").groupBy(by, "block").agg(F.collect_list(F.struct("later", "place")).alias("free"))
    sizes = words.groupBy(by, "block").agg(F.count("*").alias("n"))
    ready = sizes.join(free, [by, "block"], "left").join(asked, [by, "block"], "left")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, free, may in zip(*(batch[c].to_pylist() for c in ("n", "free", "may"))):
                out.append([_absorb([x for x in may or [] if x["of"] is m or x["of"] is None], {(f["later"], f["place"]) for f in free or []}, min(n, HEAD)) for m in (False, True)])
            pair = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))
            columns = [pa.array([o[m][i] for o in out], t) for m in (0, 1) for i, t in enumerate((pa.bool_(), pa.int32(), pair, pa.bool_()))]
            yield pa.record_batch([batch[by], pc.subtract(batch["block"], 1), *columns], [by, "block", *(f"{c}{m}" for m in (0, 1) for c in ("to", "at", "pairs", "ok"))])

    told = ", ".join(f"to{m} boolean, at{m} int, pairs{m} array<struct<a:string,b:string>>, ok{m} boolean" for m in (0, 1))
    found = ready.mapInArrow(step, f"{by} {kind}, block bigint, {told}")
    last = sizes.groupBy(by).agg(F.max("block").alias("block"))
    none = F.array().cast("array<struct<a:string,b:string>>")
    ends = last.select(by, "block", *[c for m in (0, 1) for c in (F.lit(False).alias(f"to{m}"), F.lit(0).alias(f"at{m}"), none.alias(f"pairs{m}"), F.lit(True).alias(f"ok{m}"))])
    return found.where("block >= 0").unionByName(ends)


def _absorb(may: list[dict], free: set[tuple[bool, int]], n: int) -> tuple[bool, int, list[dict], bool]:
    """Walk the first words of a block with the words that reach it, until one of its own walks has the same (empty) state."""
    known = {(x["of"] is not None, x["from"], x["place"]): x["may"] for x in may}
    names = {(x["of"] is not None, x["from"]): x["other"] for x in may} | {(False, x["place"]): x["token"] for x in may}
    single = [k for k in sorted(names, key=lambda k: (not k[0], k[1])) if k[0]]
    pairs = []
    for i in range(n + 1):
        if not single:
            for later in (False, True):
                if (later, i) in free:
                    return later, i, pairs, True
        if i == n:
            break
        for at, (old, j) in enumerate(single):
            answer = known.get((old, j, i))
            if answer is None:  # too far apart to have been asked
                return False, 0, [], False
            if answer:
                pairs.append({"a": names[old, j], "b": names[False, i]})
                del single[at]
                break
        else:
            if (False, i) not in names:
                return False, 0, [], False
            single.append((False, i))
    return False, 0, [], False


def _walk_on(vocab: DataFrame, words: DataFrame, thr: float, by: str) -> DataFrame:
    """The greedy map by walking blocks from assumed states, again and again where the block before leaves other words."""
    kind = vocab.schema[by].dataType.simpleString()
    schema = (
        f"{by} {kind}, block bigint, rank bigint, token string, forms array<string>, partner string"
    )

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        at = group["block"].max()
        single: list[tuple] = []
        rows: list[tuple] = []
        for rank, token, shape in zip(group["rank"], group["token"], group["forms"]):
            word = (rank, token, None if shape is None else frozenset(shape))
            for i, other in enumerate(single):
                if _different(word, other, thr):
                    rows += [(*other, token), (*word, other[1])]
                    del single[i]
                    break
            else:
                single.append(word)
        rows += [(*word, None) for word in single]
        out = pd.DataFrame(rows, columns=["rank", "token", "forms", "partner"])
        out["forms"] = [None if f is None else sorted(f) for f in out["forms"]]
        out[by], out["block"] = group[by].iloc[0], at
        return out[[by, "block", "rank", "token", "forms", "partner"]]

    def run(rows: DataFrame) -> DataFrame:
        """Each block with the single words that reach it (earlier ranks, marked with the block's number)."""
        return settle(rows.groupBy(by, "block").applyInPandas(walk, schema), "walked")

    columns = [by, "block", "rank", "token", "forms"]
    last = settle(words.groupBy(by).agg(F.max("block").alias("last")), "last")
    done = run(words)
    used = None
    while True:
        single = done.where("partner is null").join(last, by)
        leaving = settle(
            single.where("block < last").select(by, (F.col("block") + 1).alias("block"), *columns[2:]),
            "leaving",
        )
        if used is None:
            moved = leaving.select(by, "block").distinct()
        else:
            here, there = leaving.select(by, "block", "token"), used.select(by, "block", "token")
            moved = here.exceptAll(there).unionByName(there.exceptAll(here)).select(by, "block").distinct()
        moved = settle(moved, "moved")
        if moved.isEmpty():
            return _pairs_of(vocab, done)
        again = words.unionByName(leaving).join(moved, [by, "block"], "left_semi")
        kept = done.join(moved, [by, "block"], "left_anti")
        done = settle(kept.unionByName(run(again)), "walked")
        used = leaving


def _pairs_of(vocab: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs of the walk; words that no block paired keep their place."""
    pairs = done.where("partner is not null").select(F.col("token").alias("src"), F.col("partner").alias("dst"))
    return _complete(vocab, pairs)


def _different(one: tuple, other: tuple, thr: float) -> bool:
    if one[2] is not None and other[2] is not None and one[2] & other[2]:
        return False
    a, b = one[1], other[1]
    longest = max(len(a), len(b))
    return abs(len(a) - len(b)) / longest > thr or _edits(a, b) / longest > thr


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def swap_random(vocab: DataFrame, seed: int, order: list[Column] | None = None) -> DataFrame:
    """Random permutation of the vocabulary: words in the given order meet words in hash order."""
    here = numbered(vocab.select("token", "freq"), order or frequency_order(), name="at")
    there = numbered(vocab.select("token"), [hash_key(seed, "token")], name="at")
    return _meet(here, there)


def _meet(here: DataFrame, there: DataFrame, keys: tuple[str, ...] = ("at",)) -> DataFrame:
    left = here.select(*keys, F.col("token").alias("src"))
    right = there.select(*keys, F.col("token").alias("dst"))
    return left.join(right, list(keys)).select("src", "dst")


def _shuffled_groups(vocab: DataFrame, by: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Words numbered from 0 in hash order within their group, and the settled group sizes."""
    placed = settle(
        numbered(vocab.select("token", by), [hash_key(seed, "token")], [by], name="at", start=0), "placed"
    )
    sizes = settle(placed.groupBy(by).agg(F.count("*").alias("n")), "sizes")
    return placed.join(sizes, by), sizes


def swap_rotate(vocab: DataFrame, seed: int, by: str = "n_pieces") -> DataFrame:
    """Derangement within each group: the shuffled group is rotated by a random 1..n-1 places."""
    placed, _ = _shuffled_groups(vocab, by, seed)
    turn = F.when(F.col("n") > 1, 1 + hash_int(f"{seed}|turn", by) % (F.col("n") - 1)).otherwise(0)
    here = placed.withColumn("at", (F.col("at") - turn + F.col("n")) % F.col("n"))
    return _meet(here, placed, (by, "at"))


def swap_mutual(vocab: DataFrame, seed: int, by: str = "n_pieces") -> DataFrame:
    """The two halves of each shuffled group trade places; the last word of an odd group stays."""
    placed, _ = _shuffled_groups(vocab, by, seed)
    half = F.floor(F.col("n") / 2)
    other = (
        F.when(F.col("at") < half, F.col("at") + half)
        .when(F.col("at") < 2 * half, F.col("at") - half)
        .otherwise(F.col("at"))
    )
    return _meet(placed.withColumn("at", other), placed, (by, "at"))


def swap_lemma(vocab: DataFrame, forms: str, seed: int, thr: float = THRESHOLD, by: str = "n_pieces") -> DataFrame:
    """Half-turn of each shuffled coarse frequency bucket, repaired for related words.

    A word that shares a lemma form with its target, or is too similar to it, trades targets with the
    first word of the bucket it is unrelated to. Which word that is does not depend on earlier trades, so
    it is found by joins, and the outcome of the trades, which is that of one after the other, by joins as well.
    """
    words = coarse_buckets(vocab, by).join(vocab.select("token", F.col(forms).alias("forms")), "token")
    words = words.withColumn("group", F.concat_ws("|", by, "bucket"))
    placed = numbered(
        words.select("token", "group", "forms"), [hash_key(seed, "token")], ["group"], name="at", start=0
    )
    placed = settle(placed, "placed")
    sizes = settle(placed.groupBy("group").agg(F.count("*").alias("n")), "sizes")
    sized = placed.join(sizes, "group")
    # A list rotated right by k shows at position i what stood at i - k.
    aim = sized.withColumn("at2", (F.col("at") - F.floor(F.col("n") / 2) + F.col("n")) % F.col("n"))
    target = placed.select("group", F.col("at").alias("at2"), F.col("token").alias("dst"), F.col("forms").alias("dst_forms"))
    turned = settle(aim.join(target, ["group", "at2"]).drop("at2"), "turned")
    clash = settle(
        turned.where(~_unrelated("token", "forms", "dst", "dst_forms", thr)), "clash"
    )
    trades = settle(_first_unrelated(clash, placed, sizes, thr), "trades")
    changed = settle(_traded(turned, trades.where(F.col("with_token").isNotNull())), "changed")
    base = turned.select(F.col("token").alias("src"), "dst")
    return base.join(changed.select("src"), "src", "left_anti").unionByName(changed)


def _traded(turned: DataFrame, trades: DataFrame) -> DataFrame:
    """Targets ``(src, dst)`` of all words that take part in a trade, after all trades in their order.

    At its place a word takes the target that its partner holds by then, and the partner gets the word's first target, which is known.
    What a partner holds was given to it by the trade before, or is its first target, or was taken in a trade of its own: only
    the last case points to another trade, and such pointers are followed by doubling. Trades of one word are numbered by a
    spread sort, so the first word of a bucket, with which most words trade, does not gather them in one task.
    """
    took = trades.select("group", F.col("token").alias("cell"), "at", F.lit(None).cast("string").alias("given"))
    got = trades.select("group", F.col("with_token").alias("cell"), "at", F.col("dst").alias("given"))
    events = settle(numbered(took.unionByName(got), [F.col("at")], ["group", "cell"], name="nth"), "events")
    own = F.when(F.col("given").isNull(), F.col("at"))
    before = events.select("group", "cell", (F.col("nth") + 1).alias("nth"), F.col("given").alias("held"), own.alias("ref"))
    first = turned.select("group", F.col("token").alias("cell"), F.lit(1).cast("bigint").alias("nth"), F.col("dst").alias("held"))
    before = before.unionByName(first.withColumn("ref", F.lit(None).cast("bigint")))
    held = events.where("given IS NOT NULL").join(before, ["group", "cell", "nth"]).select("group", "at", "held", "ref")
    held = settle(held, "held")
    while not held.where("held IS NULL").isEmpty():
        ahead = held.select("group", F.col("at").alias("ref"), "held", F.col("ref").alias("next"))
        followed = held.where("held IS NULL").drop("held").join(ahead, ["group", "ref"])
        followed = followed.select("group", "at", "held", F.col("next").alias("ref"))
        held = settle(held.where("held IS NOT NULL").unionByName(followed), "held")
    last = events.groupBy("group", "cell").agg(F.max_by(F.struct("at", "given"), "nth").alias("e"))
    last = last.select("group", F.col("cell").alias("src"), "e.at", "e.given")
    return last.join(held, ["group", "at"]).select("src", F.coalesce("given", "held").alias("dst"))


def _unrelated(a: str, a_forms: str, b: str, b_forms: str, thr: float) -> Column:
    overlap = F.coalesce(F.arrays_overlap(a_forms, b_forms), F.lit(False))
    return ~overlap & (norm_lev(a, b) > thr)


def _first_unrelated(clash: DataFrame, placed: DataFrame, sizes: DataFrame, thr: float) -> DataFrame:
    """For each clashing word the first word of its group it is unrelated to, if any.

    The group is searched in slices of doubling length; a word leaves the search at its first hit, and
    nearly all do in the first slice of 16.
    """
    longest = sizes.agg(F.max("n")).first()[0] or 0
    open_words, found, low, high = clash, None, 0, 16
    while low < longest and not open_words.isEmpty():
        part = placed.where(F.col("at").between(low, high - 1)).select(
            "group", F.col("at").alias("with_at"), F.col("token").alias("with_token"), F.col("forms").alias("with_forms")
        )
        hits = settle(
            open_words.join(part, "group")
            .where(_unrelated("token", "forms", "with_token", "with_forms", thr))
            .groupBy("group", "at", "token", "dst")
            .agg(F.min_by("with_token", "with_at").alias("with_token")),
            "hits",
        )
        found = hits if found is None else found.unionByName(hits)
        open_words = settle(open_words.join(hits.select("group", "token"), ["group", "token"], "left_anti"), "open")
        low, high = high, high * 2
    if found is None:
        return clash.select("group", "at", "token", "dst", F.lit(None).cast("string").alias("with_token"))
    return found


def swap_nonsense(vocab: DataFrame, pieces_vocab: DataFrame, seed: int, letters: int = 4) -> DataFrame:
    """Letter strings that break into one piece per letter, in alphabetical order, for shuffled words.

    If the strings of ``letters`` letters are too few, longer ones follow, by length. All but the last letter of a string that
    breaks into letters break into letters too, so longer strings are made of the ones at hand, in their order, as far as they are needed.
    """
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    spark = vocab.sparkSession
    digit = lambda place: F.floor(F.col("id") / 26 ** (letters - 1 - place)) % 26
    letter = lambda place: F.substring(F.lit(alphabet), digit(place).cast("int") + 1, F.lit(1))

    def placed(strings: DataFrame, start: int) -> DataFrame:
        fit = wordpieces(strings, pieces_vocab).where(F.col("n_pieces") == F.length("token"))
        order = [F.length("token"), F.col("token")]
        return settle(numbered(fit.select("token"), order, name="at", start=start), "nonsense")

    here = settle(numbered(vocab.select("token"), [hash_key(seed, "token")], name="at"), "words")
    there = placed(spark.range(26**letters).select(F.concat(*[letter(i) for i in range(letters)]).alias("token")), 1)
    wanted, found, used = here.count(), there.count(), 0
    while found < wanted:
        if used == found:
            raise ValueError("fewer nonsense words than vocabulary words")
        upto = min(found, used + (wanted - found) // len(alphabet) + 1)
        longer = F.explode(F.array(*[F.concat("token", F.lit(x)) for x in alphabet])).alias("token")
        more = placed(there.where(F.col("at").between(used + 1, upto)).select(longer), found + 1)
        there, found, used = there.unionByName(more), found + more.count(), upto
    return _meet(here, there)


def swap_oov(task: DataFrame, external: DataFrame, seed: int, mode: str = "similar") -> DataFrame:
    """Words of an external corpus that the task never uses.

    ``similar``: a random sample in frequency order meets the task words in frequency order.
    ``rare``: external words seen once, in random order. ``inverted``: the most frequent external words
    replace the least frequent task words.
    """
    here = settle(freq_rank(task.select("token", "freq")).withColumnRenamed("rank", "at"), "task")
    size = here.count()
    unseen = external.select("token", "freq").join(task.select("token"), "token", "left_anti")
    if mode == "similar":
        sample = numbered(unseen, [hash_key(seed, "token")], name="at").where(F.col("at") <= size)
        there = numbered(sample.drop("at"), frequency_order(), name="at")
    elif mode == "rare":
        there = numbered(unseen.where("freq = 1"), [hash_key(seed, "token")], name="at")
    elif mode == "inverted":
        there = numbered(unseen, frequency_order(), name="at")
        here = here.withColumn("at", size + 1 - F.col("at"))
    else:
        raise ValueError(f"unknown mode {mode}")
    there = settle(there.where(F.col("at") <= size), "external")
    if there.count() < size:
        raise ValueError("the external corpus has too few words")
    return _meet(here, there)


def piece_category(token: Column, token_id: Column) -> Column:
    """Class of a word piece within which ids may be exchanged; null for the special pieces."""
    ends = [998, 1013, 1023, 1036, 1062, 1995]  # fixed values: last id of each reserved range
    category = F.when(token.isin(fixed.SPECIAL_PIECES), F.lit(None).cast("string"))
    for end in ends:
        category = category.when(token_id <= end, F.lit(f"to {end}"))
    return category.otherwise(F.concat(F.lit("bytes "), utf8_length(token)))


def permute_vocab(vocab: DataFrame, seed: int) -> DataFrame:
    """Word-piece vocabulary with the pieces exchanged inside their category: ``(id, token, new_token)``."""
    classed = vocab.select("token", "id", piece_category(F.col("token"), F.col("id")).alias("category"))
    free = classed.where("category is not null")
    here = numbered(free, [F.col("id")], ["category"], name="at")
    there = numbered(free, [hash_key(seed, "token")], ["category"], name="at").select(
        "category", "at", F.col("token").alias("new_token")
    )
    moved = here.join(there, ["category", "at"]).select("id", "token", "new_token")
    fixed_rows = classed.where("category is null").select("id", "token", F.col("token").alias("new_token"))
    return moved.unionByName(fixed_rows)


def permute_rows(emb: DataFrame, key: str, value: str, seed: int) -> DataFrame:
    """Embedding matrix with its rows exchanged at random: key ``k`` gets the row of ``old_key``.

    The permutation is built from the keys alone and written; the vectors then move once, unsorted.
    """
    here = numbered(emb.select(key), [F.col(key)], name="at")
    there = numbered(emb.select(F.col(key).alias("old_key")), [hash_key(seed, "old_key")], name="at")
    moves = settle(here.join(there, "at").select(key, "old_key"), "moves")
    moves = F.broadcast(moves) if is_small(moves) else moves.hint("shuffle_hash")
    return emb.select(F.col(key).alias("old_key"), value).join(moves, "old_key").select(key, "old_key", value)


def mean_vector(emb: DataFrame, value: str) -> DataFrame:
    """Mean of all rows per dimension, as one row per dimension (averaged before the shuffle)."""
    return (
        emb.select(F.posexplode_outer(value).alias("dim", "x"))
        .where("dim is not null")
        .groupBy("dim")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"))
    )


def control_map(mapping: DataFrame, seed: int) -> DataFrame:
    """Each replacement word gets an independent random source word, with replacement."""
    sources = settle(numbered(mapping.select(F.col("src").alias("label")), [F.col("label")], name="at", start=0), "sources")
    size = sources.count()
    return (
        mapping.select("dst", (hash_int(seed, "dst") % max(size, 1)).alias("at"))
        .join(sources, "at")
        .select("dst", "label")
    )


def invert_map(mapping: DataFrame) -> DataFrame:
    """Replacement word back to its source word."""
    return mapping.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def weighed(mapping: DataFrame, vocab: DataFrame) -> DataFrame:
    """Map with the frequency of its source words, by which a rewrite salts the common ones."""
    weights = vocab.select(F.col("token").alias("src"), "freq")
    return mapping.join(weights, "src", "left").select("src", "dst", F.coalesce("freq", F.lit(0)).alias("freq"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
            )
        ).alias("p")
    ).select("p.src", "p.dst")


def _complete(vocab: DataFrame, mapped: DataFrame) -> DataFrame:
    """Add the words without a partner, mapped to themselves."""
    rest = vocab.select(F.col("token").alias("src")).join(mapped, "src", "left")
    return rest.select("src", F.coalesce("dst", "src").alias("dst"))
