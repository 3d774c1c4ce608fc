"""Repair of conversations by the cheapest edits, found on an automaton that all conversations share.

Every row of a conversation is reduced to one signature letter, of its role and its first fault. Conversations are sorted by
their signature read from the end, so that those with a common ending stand together; the endings then form an
automaton of which a task holds one path at a time. Each node (an ending that any number of conversations share) is settled once: for every grammar
state the cost to go, the cheapest edit, and with it the best rest of the audit. Of equally cheap edits the least letter wins;
as every edit has a letter of its own and leads to one state, the whole audit is the least one.

Rows are sorted by conversation and turn over all tasks, so a conversation may be cut anywhere: pieces of at most ``size``
rows become letters where they are, and a message seen in an earlier piece is found by a join on digests, of those conversations only that have
several pieces. What meets in one task for a conversation is a letter a row, which is the size of its audit. The texts move once, beside the audits,
and pass through a task in order without being held.

Defined cases: null roles, texts, keys and turns count as one space in the checksum and the repaired rows; rows without a key are one
conversation; null turns come first. Rows of equal turn stand in the order of role, then text (by its first 64 characters and a digest). An empty
role has no initial, so it can only be changed or deleted. A conversation without rows gets zeros, an empty audit and no repaired rows. Repeated rows are
duplicates. An empty table gives no rows. Texts of any length pass whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import arrow, settle

#: Rows of a piece of a conversation.
PIECE = 4096
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
SPACES = " \t\n\x0b\x0c\r"

# Grammar states and where the next letter of a role leads; the roles that an edit can give.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STEPS = {(START, "s"): AFTER_SYSTEM, (START, "u"): AFTER_USER, (AFTER_SYSTEM, "u"): AFTER_USER, (AFTER_USER, "a"): AFTER_ASSISTANT, (AFTER_ASSISTANT, "u"): AFTER_USER}
GIVEN = {s: next(r for r in "ua" if (s, r) in STEPS) for s in range(4)}
ROLES = {"u": "user", "a": "assistant"}
NEVER = 1 << 60

# Signature letters: of each role initial (s, u, a, or o for any other) one for every fault.
FAULTS = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
LETTERS = {(role, fault): chr(ord("A") + 4 * i + j) for i, role in enumerate("suao") for fault, j in FAULTS.items()}
MEANT = {letter: meant for meant, letter in LETTERS.items()}
DUPLICATES = str.maketrans({LETTERS[role, fault]: LETTERS[role, "duplicate"] for role in "suao" for fault in ("", "truncated")})


def spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows as (conv, turn, role, text), nulls of role and text as one space."""
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"))


def damage(plain: DataFrame) -> DataFrame:
    """The rows with faults put in by their checksum; dropped ones stay as rows with ``gone``, so that no conversation is lost.

    Of 20 kinds, 0 drops a row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    kind = F.crc32(F.concat(spaced("conv"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = plain.withColumn("kind", kind)
    out = out.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).withColumn("text", text)
    out = out.withColumn("gone", F.col("kind") == 0)
    return out.withColumn("time", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "time")


def own_letter() -> Column:
    """Letter of a row by itself: role initial, and blank or truncated."""
    initial = F.substring("role", 1, 1)
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    both = F.concat(role, fault)
    out = F.lit("")
    for (r, f), letter in LETTERS.items():
        out = F.when(both == r + f, letter).otherwise(out)
    return out


ORDER = ["conv", "turn", "role", "head", "digest"]


def marked(damaged: DataFrame) -> DataFrame:
    """Rows with what orders them, and the letter that they have by themselves (none for rows that are gone)."""
    digest = F.unhex(F.md5(F.concat_ws("\n", "role", "text")))
    letter = F.when(F.col("gone"), "").otherwise(own_letter())
    return damaged.select("*", F.substring("text", 1, 64).alias("head"), digest.alias("digest"), letter.alias("letter"))


def pieces(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """Sorted conversations in pieces: letters, turns, and digests of those that may go on in another piece.

    Columns: conv, piece (ascending within a conversation), letters (duplicates within the piece told), least, most and turns
    (distinct ones), digests (null if the conversation lies in this piece alone).
    """
    columns = ["conv", "turn", "letter", "digest"]
    light = rows.select("conv", "turn", "role", "head", "digest", "letter").orderBy(*[F.asc_nulls_first(c) for c in ORDER]).select(*columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        conv, open_ = None, True  # the first conversation of a task may have begun in the task before

        def told(last: bool) -> tuple:
            nonlocal count
            seen, letters, digests = set(), [], []
            for _, turn, letter, digest in held:
                if letter:
                    letters.append(letter.translate(DUPLICATES) if digest in seen else letter)
                    seen.add(digest)
                    digests.append(digest)
            times = [t for _, t, letter, _ in held if letter and t is not None]
            count += 1
            whole = not open_ and last
            return (conv, (part << 32) + count, "".join(letters), min(times, default=None), max(times, default=None), len(set(times)), None if whole else b"".join(digests))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv", "piece", "letters", "least", "most", "turns", "digests"])

        for batch in batches:
            out = []
            kind = batch.schema.field("conv").type
            for row in zip(*(batch[c].to_pylist() for c in columns)):
                if held and (row[0] != conv or len(held) == size):
                    out.append(told(row[0] != conv))
                    open_ = row[0] == conv
                    held.clear()
                conv = row[0]
                held.append(row)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([told(False)])

    fields = f"conv {rows.schema['conv'].dataType.simpleString()}, piece long, letters string, least long, most long, turns long, digests binary"
    return settle(arrow(light, cut, fields), "pieces")


def signatures(found: DataFrame) -> DataFrame:
    """One row for each conversation: conv, reversed (its letters from the end), gaps."""
    alone = found.where("digests IS NULL")
    # messages of an earlier piece: only conversations that may have several pieces are looked at
    at = F.sequence(F.lit(0), F.greatest(F.length("digests") / 16 - 1, F.lit(0)).cast("int"))
    several = found.where("digests IS NOT NULL")
    keys = several.where(F.length("digests") > 0).select("conv", "piece", F.explode(F.transform(at, lambda i: F.substring(F.col("digests"), i * 16 + 1, F.lit(16)))).alias("digest"))
    first = keys.groupBy(F.col("conv").alias("its"), F.col("digest").alias("same")).agg(F.min("piece").alias("first"), F.max("piece").alias("last")).where("first < last")
    seen = keys.join(first, F.col("conv").eqNullSafe(F.col("its")) & (F.col("digest") == F.col("same")) & (F.col("piece") > F.col("first")))
    again = seen.groupBy(F.col("conv").alias("its"), F.col("piece").alias("at")).agg(F.collect_set("digest").alias("again"))
    later = several.join(again, F.col("conv").eqNullSafe(F.col("its")) & (F.col("piece") == F.col("at")), "left").drop("its", "at")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = []
            for own, digests, seen in zip(*(batch[c].to_pylist() for c in ("letters", "digests", "again"))):
                known = set(seen or ())
                letters.append("".join(x.translate(DUPLICATES) if digests[16 * i : 16 * i + 16] in known else x for i, x in enumerate(own)) if known else own)
            yield batch.drop_columns(["letters", "digests", "again"]).append_column("letters", pa.array(letters, pa.string()))

    out = ["conv", "piece", "letters", "least", "most", "turns"]
    kinds = {f.name: f for f in found.schema.fields}
    told = arrow(later, tell, ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in ("conv", "piece", "least", "most", "turns", "letters")))
    each = alone.select(*out).unionByName(told.select(*out))
    whole = each.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("piece", "letters", "least", "most", "turns"))).alias("p"))
    # a turn that goes on in the next piece counts once; pieces without turns lie before all others or hold rows that are gone
    timed = F.filter("p", lambda x: x["least"].isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("most"))
    distinct = F.aggregate(timed, start, lambda s, x: F.struct((s["n"] + x["turns"] - F.when(s["most"] == x["least"], 1).otherwise(0)).alias("n"), x["most"].alias("most")), lambda s: s["n"])
    gaps = F.array_max(timed["most"]) - F.array_min(timed["least"]) + 1 - distinct
    return whole.select("conv", F.reverse(F.array_join(F.col("p.letters"), "")).alias("reversed"), F.coalesce(gaps, F.lit(0)).alias("gaps"))


class Node(NamedTuple):
    """What an ending of conversations means for the rest: for each grammar state the cost to go above the least, and the edit."""

    costs: tuple[int, ...]
    edits: tuple[str, ...]


def node(best: list[tuple[int, str]]) -> tuple[Node, int]:
    """Node of the cheapest (cost, edit) for each state, rows put in before it included, and the least cost."""
    for _ in range(3):  # more than two rows in a row are never worth it
        for s in range(4):
            best[s] = min(best[s], (INSERT + best[STEPS[s, GIVEN[s]]][0], "I"))
    least = min(c for c, _ in best)
    return Node(tuple(c - least for c, _ in best), tuple(e for _, e in best)), least


def options(letter: str, costs: tuple[int, ...], state: int) -> Iterator[tuple[int, str]]:
    """Cost and edit of every way to deal with a row, given the costs behind it."""
    role, fault = MEANT[letter]
    yield DELETE + costs[state], "D"
    if fault not in ("blank", "duplicate"):
        cut = CUT if fault == "truncated" else 0
        if (state, role) in STEPS:
            yield cut + costs[STEPS[state, role]], "K"
        yield cut + REROLE + costs[STEPS[state, GIVEN[state]]], "R"


#: Behind the last row nothing is left but to add what the grammar asks for.
END, _ = node([(0, "") if s in (START, AFTER_ASSISTANT) else (NEVER, "") for s in range(4)])


class Automaton:
    """Endings as nodes, equal ones made once; the path of the last conversation is kept, for the next one shares its ending.

    Two endings are one node if they mean the same for whatever stands before them; the costs of a path are kept beside it.
    """

    def __init__(self) -> None:
        self.nodes: dict[tuple[str, tuple[int, ...]], tuple[Node, int]] = {}
        self.path, self.least, self.letters, self.steps = [END], [0], "", 0
        self.last: tuple[int, str] | None = None

    def repair(self, reversed_: str) -> tuple[int, str]:
        """Cost and audit of a conversation given by its letters from the end."""
        if self.last is not None and reversed_ == self.letters:
            return self.last
        same = len(os.path.commonprefix([reversed_, self.letters]))
        del self.path[same + 1 :], self.least[same + 1 :]
        for letter in reversed_[same:]:
            key = (letter, self.path[-1].costs)
            if key not in self.nodes:
                self.nodes[key] = node([min(options(letter, key[1], s)) for s in range(4)])
            made, cost = self.nodes[key]
            self.path.append(made)
            self.least.append(self.least[-1] + cost)
            self.steps += 1
        self.letters = reversed_
        self.last = (self.least[-1] + self.path[-1].costs[START], self.audit())
        return self.last

    def audit(self) -> str:
        """The edits of the cheapest repair, read along the path back to the end."""
        out, state, left = [], START, len(self.letters)
        while edit := self.path[left].edits[state]:
            out.append(edit)
            if edit != "D":
                state = STEPS[state, MEANT[self.letters[left - 1]][0] if edit == "K" else GIVEN[state]]
            if edit != "I":
                left -= 1
        return "".join(out)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def illegal(letters: str) -> int:
    roles = [MEANT[x][0] for x in letters]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def audits(told: DataFrame) -> DataFrame:
    """Cost and audit of every conversation, by one pass over the signatures sorted from the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            out = []
            for reversed_ in batch["reversed"].to_pylist():
                cost, edits = automaton.repair(reversed_)
                faults = [sum(map(reversed_.count, (LETTERS[r, f] for r in "suao"))) for f in ("blank", "duplicate", "truncated")]
                out.append((*faults, illegal(reversed_[::-1]), cost, edits))
            kinds = [pa.int64()] * 5 + [pa.string()]
            columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.record_batch([batch["conv"], batch["gaps"], *columns], ["conv", *COUNTS, "audit"])

    kind = told.schema["conv"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return arrow(told.orderBy("reversed", F.asc_nulls_first("conv")), run, f"conv {kind}, {counts}, audit string")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Repaired rows in order, each conversation after a row (place 0) with its counts and audit.

    Columns: conv, place, edit, role, text, and in the first row the counts and the audit. A conversation's rows stand
    together and in order in one partition. Texts are shuffled once and none is held.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    heads = found.select("conv", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("head"), none("binary").alias("digest"), none("string").alias("text"), *COUNTS, "audit")
    body = rows.where(~F.col("gone")).select("conv", F.lit(1).alias("kind"), "turn", "role", "head", "digest", "text", *[none("long").alias(c) for c in COUNTS], none("string").alias("audit"))
    every = heads.unionByName(body).repartition("conv").sortWithinPartitions(*[F.asc_nulls_first(c) for c in ("conv", "kind", *ORDER[1:])])
    every = every.select("conv", "kind", "role", "text", *COUNTS, "audit")
    fields = ["conv", "place", "edit", "role", "text", *COUNTS, "audit"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, state, place, now = "", 0, START, 0, None

        def put(role: str, text: str, edit: str) -> tuple:
            nonlocal place, state
            place += 1
            state = STEPS[state, role[:1]]
            return (now, place, edit, role, text, *[None] * len(COUNTS), None)

        def added() -> Iterator[tuple]:
            nonlocal at
            while at < len(edits) and edits[at] == "I":
                at += 1
                yield put(ROLES[GIVEN[state]], "", "I")

        for batch in batches:
            out = []
            for conv, kind_, role, text, *counts, told in zip(*(batch[c].to_pylist() for c in batch.schema.names)):
                if not kind_:
                    edits, at, state, place, now = told, 0, START, 0, conv
                    out.append((conv, 0, None, None, None, *counts, told))
                else:
                    edit = edits[at]
                    at += 1
                    if edit != "D":
                        out.append(put(role if edit == "K" else ROLES[GIVEN[state]], text, edit))
                out.extend(added())
            kinds = [batch.schema.field("conv").type, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * len(COUNTS), pa.string()]
            yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], fields)

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return arrow(every, walk, f"conv {kind}, place long, edit string, role string, text string, {counts}, audit string")


def digested(found: DataFrame) -> DataFrame:
    """One row for each conversation: counts, audit, and the digest of its repaired rows as ``role:text`` lines.

    Takes the result of ``repaired`` as it stands; a digest is fed row by row.
    """
    out = ["conv", *COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest = None, None
        for batch in batches:
            done = []
            rows = zip(*(batch[c].to_pylist() for c in ("conv", "place", "role", "text", *COUNTS, "audit")))
            for (conv, first), some in groupby(rows, key=lambda r: (r[0], r[1] == 0)):
                for row in some:
                    if first:
                        if head is not None:
                            done.append((*head, digest.hexdigest()))
                        head, digest = (conv, *row[4:]), hashlib.sha256()
                    else:
                        digest.update(f"{chr(10) if row[1] > 1 else ''}{row[2]}:{row[3]}".encode())
            yield batch_of(done, batch.schema)
        if head is not None:
            yield batch_of([(*head, digest.hexdigest())], batch.schema)

    def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        kinds = [schema.field("conv").type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], out)

    kind = found.schema["conv"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return arrow(found, run, f"conv {kind}, {counts}, audit string, repaired_sha256 string")


def repair(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """Repaired conversations of rows (conv, turn, role, text, gone): see ``repaired``."""
    ready = marked(rows)
    return repaired(ready, settle(audits(signatures(pieces(ready, size))), "audits"))


def _sql() -> str:
    """The repair as a recursion from the last row; a state's best way is a pair of key (cost, audit) and lines."""
    add = lambda b, cost, edit, line: f"[printf('%06d', left({b}[1], 6)::INT + {cost}) || '{edit}' || substr({b}[1], 7), {line} || {b}[2]]"
    new = lambda state: f"chr(10) || '{ROLES[GIVEN[state]]}:'"
    here = []
    for s in range(4):
        ways = [add(f"b{s}", DELETE, "D", "''")]
        for (state, role), to in STEPS.items():
            if state == s:
                ways.append(f"CASE WHEN NOT out AND i = '{role}' THEN {add(f'b{to}', 'cut', 'K', 'line')} END")
        ways.append(f"CASE WHEN NOT out THEN {add(f'b{STEPS[s, GIVEN[s]]}', f'cut + {REROLE}', 'R', new(s) + ' || text')} END")
        here.append(f"list_min([{', '.join(ways)}]) AS h{s}")
    best = []
    for s in range(4):
        one = STEPS[s, GIVEN[s]]
        two = STEPS[one, GIVEN[one]]
        best.append(f"list_min([h{s}, {add(f'h{one}', INSERT, 'I', new(s))}, {add(add(f'h{two}', INSERT, 'I', new(one)), INSERT, 'I', new(s))}])")
    last = r"regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1)"
    return rf"""
    WITH RECURSIVE keys AS (
        SELECT DISTINCT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    sums AS (
        SELECT conv_id, turn, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
            flatten(list_transform(string_split(k, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::BIGINT) ELSE s // 2 END)) % 20 AS kind FROM keys),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
            CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
        FROM (SELECT c.*, kind, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS time FROM conversations c
            JOIN sums s ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.turn IS NOT DISTINCT FROM s.turn) WHERE kind <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
    faulty AS (
        SELECT *, CASE WHEN {last} = '' THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
            WHEN {last} NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
            left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
    told AS MATERIALIZED (
        SELECT *, fault IN ('blank', 'duplicate') AS out, CASE WHEN fault = 'truncated' THEN {CUT} ELSE 0 END AS cut,
            chr(10) || role || ':' || text AS line, count(*) OVER (PARTITION BY conv_id) - n AS behind FROM faulty),
    -- the best way on for each state: start, after system, after user, after assistant
    back AS (
        SELECT conv_id, 0::BIGINT AS done, ['000000', ''] AS b0, ['000006II', chr(10) || 'user:' || chr(10) || 'assistant:'] AS b1,
            ['000003I', chr(10) || 'assistant:'] AS b2, ['000000', ''] AS b3
        FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT conv_id, done + 1, {", ".join(best)} FROM (
            SELECT b.conv_id, b.done, {", ".join(here)}
            FROM back b JOIN told r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.behind = b.done)),
    whole AS (SELECT conv_id, max_by(b0, done) AS b FROM back GROUP BY conv_id),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
            count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
            count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id)
    SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
        coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, left(b[1], 6)::BIGINT AS cost,
        substr(b[1], 7) AS audit, sha256(substr(b[2], 2)) AS repaired_sha256
    FROM whole w LEFT JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id"""


SQL = _sql()
