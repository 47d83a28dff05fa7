"""Conversation repair: cheapest edits that make the turns alternate, solved once per shared suffix of all conversations.

What a repair costs depends on a conversation's signature only: per row, the initial of its role and its first fault, as
one letter. Signatures are sorted by their reversed text, so those that end alike are neighbours and share the nodes of
their common suffix: a node is made from a letter and the node behind it, and holds for each state of the grammar the cost
to go and the edit that begins the best audit from there. The rest of the audit is read off the nodes that follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import NULL_ID
from vicinage.session import cut

WHITE = " \t\n\x0b\x0c\r"
INITIALS = "sua"              # of system, user, assistant; any other role is none of them
FAULTS = ("", "blank", "duplicate", "truncated")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_LETTERS = "abcdefghijklmnop"  # initial * 4 + fault
_START, _SYSTEM, _USER, _DONE = range(4)
# the grammar (s?(ua)+)?: where each state goes by an initial, and where its next turn of user or assistant leads
_GOES = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _DONE}, {"u": _USER})
_NEXT = (_USER, _USER, _DONE, _USER)
_ROLE = ("user", "user", "assistant", "user")

Node = tuple[tuple[int, str], ...]


def _with_inserts(best: list[tuple[float, str]]) -> Node:
    """The choices of a node's states once an inserted turn may come first; an insert costs, so two rounds settle them."""
    for _ in range(3):
        best = [min(own, (best[_NEXT[q]][0] + INSERT, "I")) for q, own in enumerate(best)]
    return tuple(best)


END: Node = _with_inserts([(0, ""), (float("inf"), ""), (float("inf"), ""), (0, "")])


def node_before(letter: str, behind: Node) -> Node:
    """The node of a suffix that begins with `letter`: per state (cost to go, first edit), ties by the edit's letter.

    An edit's letter settles the state it leads to, so the least letter among the cheapest begins the least audit.
    """
    initial, fault = divmod(_LETTERS.index(letter), 4)
    initial = (*INITIALS, "")[initial]
    best: list[tuple[float, str]] = []
    for state in range(4):
        ways = [(behind[state][0] + DELETE, "D")]
        if FAULTS[fault] not in ("blank", "duplicate"):
            extra = TRUNCATED if FAULTS[fault] else 0
            if initial in _GOES[state]:
                ways.append((behind[_GOES[state][initial]][0] + KEEP + extra, "K"))
            ways.append((behind[_NEXT[state]][0] + REROLE + extra, "R"))
        best.append(min(ways))
    return _with_inserts(best)


def audit_of(signature: str, nodes: list[Node]) -> str:
    """The best edits of a whole signature; nodes[k] is the node of its last k letters."""
    state, at, edits = _START, len(signature), []
    while True:
        edit = nodes[at][state][1]
        if not edit:
            return "".join(edits)
        edits.append(edit)
        if edit == "K":
            state = _GOES[state][(*INITIALS, "")[_LETTERS.index(signature[len(signature) - at]) // 4]]
        elif edit != "D":
            state = _NEXT[state]
        at -= edit != "I"


_FOUND = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def solve(signatures: DataFrame) -> DataFrame:
    """(signature, blank, duplicate, truncated, illegal, cost, audit) of each distinct signature.

    Sorted by reversed text, the path from the end to the last signature is all that a task holds of the automaton: what
    leaves the path never comes back. Tasks share no more than the path at their border.
    """
    legal = {"su", "ua", "au"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes = "", [END]
        for batch in batches:
            rows = []
            for turned in batch.column(0).to_pylist():
                shared, most = 0, min(len(turned), len(last))
                while shared < most and turned[shared] == last[shared]:
                    shared += 1
                del nodes[shared + 1:]
                for letter in turned[shared:]:
                    nodes.append(node_before(letter, nodes[-1]))
                last = turned
                signature = turned[::-1]
                kinds = [divmod(_LETTERS.index(x), 4) for x in signature]
                faults = [f for _, f in kinds]
                spelt = "".join((*INITIALS, "?")[i] for i, _ in kinds)
                illegal = sum(spelt[i:i + 2] not in legal for i in range(len(spelt) - 1))
                rows.append((signature, *(faults.count(k) for k in (1, 2, 3)), illegal, nodes[-1][_START][0], audit_of(signature, nodes)))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.string(), *[pa.int64()] * 5, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)],
                                             ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    turned = signatures.select(F.reverse("signature").alias("turned")).distinct()
    return turned.repartitionByRange("turned").sortWithinPartitions("turned").mapInArrow(run, _FOUND)


def _plain(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, h, text): nulls of role and text as one space, and a hash that orders rows of one turn."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.xxhash64(text).alias("h"), text.alias("text"))


def _told(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, h, kind) for every row: texts become hashes and flags before anything is shuffled.

    kind: initial * 4 + fault; duplicates within one turn are neighbours and left to `_segments`.
    """
    end = F.rtrim("text", F.lit(WHITE))
    fault = F.when(end == "", FAULTS.index("blank")).when(~F.substring(end, -1, 1).isin(".", "!", "?"), FAULTS.index("truncated")).otherwise(0)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) * 4 + fault
    told = rows.select("conv", "turn", "role", "h", number.alias("kind"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # joined from a checkpoint, not from the aggregation, so that a hot text can be split
    first = cut(told.groupBy("conv", "role", "h").agg(F.min(turn).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    again = F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn")) & (F.pmod("kind", F.lit(4)) != FAULTS.index("blank"))
    kind = F.when(again, F.col("kind") - F.pmod("kind", F.lit(4)) + FAULTS.index("duplicate")).otherwise(F.col("kind"))
    return told.join(first, ["conv", "role", "h"], "left").select("conv", "turn", "role", "h", kind.alias("kind"))


def _segments(told: DataFrame) -> DataFrame:
    """(conv, part, letters): what each task of a range sort holds of a conversation, one letter a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, letters, last = TaskContext.get().partitionId(), None, [], None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                kind = row[4]
                if row[0] != conv:
                    if letters:
                        done.append((conv, "".join(letters)))
                    conv, letters = row[0], []
                elif row[:4] == last and FAULTS[kind % 4] != "blank":
                    kind += FAULTS.index("duplicate") - kind % 4
                last = row[:4]
                letters.append(_LETTERS[kind])
            yield made(part, done)
        if letters:
            yield made(part, [(conv, "".join(letters))])

    def made(part: int, done: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], type=pa.int64()), pa.array([part] * len(done), type=pa.int64()),
                                           pa.array([x for _, x in done], type=pa.string())], ["conv", "part", "letters"])

    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h")]
    return told.select("conv", "turn", "role", "h", F.col("kind").cast("int")).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, "conv long, part long, letters string")


def plans(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, signature) of every conversation in `rows` as `_plain` makes them."""
    told = _told(rows)
    pieces = F.array_sort(F.collect_list(F.struct("part", "letters")))   # one entry for each task that a conversation spans
    signed = cut(_segments(told).groupBy("conv").agg(F.array_join(F.transform(pieces, lambda p: p["letters"]), "").alias("signature")))
    gaps = rows.groupBy("conv", "turn").agg(F.lit(1).alias("_one")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    return signed.join(solve(signed.select("signature")), "signature").join(gaps, "conv").select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "signature")


def _edited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit, then its rows in order, conversations kept together. A row is never held with its neighbours."""
    audits = found.select("conv", F.lit(True).alias("plan"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                          F.lit(0).cast("long").alias("h"), F.col("audit").alias("text"))
    turns = rows.select("conv", F.lit(False).alias("plan"), "turn", "role", "h", "text")
    return audits.unionByName(turns).repartition("conv").sortWithinPartitions(
        "conv", F.col("plan").desc(), F.col("turn").asc_nulls_first(), "role", "h")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str, str]]:
    """(conv, place, role, text) of the repaired rows, streamed; place -1 announces a conversation, which may have none."""
    conv = audit = None
    at = place = state = 0

    def inserted():
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            yield conv, place, _ROLE[state], ""
            state, at, place = _NEXT[state], at + 1, place + 1

    for batch in batches:
        for c, is_plan, _, role, _, text in zip(*(x.to_pylist() for x in batch.columns)):
            if is_plan:
                if conv is not None:
                    yield from inserted()
                conv, audit, at, place, state = c, text, 0, 0, _START
                yield conv, -1, "", ""
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                role, state = _ROLE[state], _NEXT[state]
            else:
                state = _GOES[state][role[:1]]
            yield conv, place, role, text
            place += 1
    if conv is not None:
        yield from inserted()


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows of the repaired conversations, places from 0; see `repair`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in _repaired(batches):
            if row[1] >= 0:
                held.append(row)
            if len(held) >= 1000:
                yield made(held)
                held = []
        yield made(held)

    def made(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], type=t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                          ["conv", "place", "role", "text"])

    plain = _plain(rows)
    out = _edited(plain, plans(plain)).mapInArrow(run, "conv long, place long, role string, text string")
    return out.select(F.when(F.col("conv") != NULL_ID, F.col("conv")).alias("conv_id"), "place", "role", "text")


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, signature, repaired_sha256) per conversation.

    rows: (conv_id, turn, role, text). conversations: (conv_id) of those to report even if `rows` has none of their rows.
    Rows are taken by turn, nulls first; within a turn by role, then by a hash of the text. Null role or text is one
    space; a null conv_id is a conversation of its own. A row's first fault counts: blank, duplicate (role and text seen
    earlier; repeated rows are duplicates), truncated. gaps counts the turns missing between the least and the greatest.
    The audit holds the initials of the cheapest edits (Keep, Rerole, Delete, Insert) that make the initials of the roles
    `(s?(ua)+)?`, the ASCII-least of equally cheap ones; a role outside system, user and assistant can't be kept. The hash
    is that of the repaired rows as role:text, joined by newlines. A conversation without rows has zeros, an empty audit
    and the hash of nothing; an empty table gives an empty result. Other columns are not looked at.

    A conversation's signature and audit are one letter a row in one string; its texts are streamed, never gathered.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, done = None, None, []
        for c, place, role, text in _repaired(batches):
            if place < 0:
                if digest:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
                if len(done) >= 1000:
                    yield made(done)
                    done = []
            else:
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if digest:
            done.append((conv, digest.hexdigest()))
        yield made(done)

    def made(done: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], type=pa.int64()), pa.array([h for _, h in done], type=pa.string())],
                                          ["conv", "repaired_sha256"])

    plain = _plain(rows)
    found = cut(plans(plain))
    hashes = _edited(plain, found).mapInArrow(run, "conv long, repaired_sha256 string")
    out = found.join(hashes, "conv")
    if conversations is not None:
        every = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv")).distinct()
        out = every.join(out, "conv", "left")
    counts = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("audit", "signature")]
    return out.select(F.when(F.col("conv") != NULL_ID, F.col("conv")).alias("conv_id"), *counts, *texts,
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by crc32 of `conv_id:turn`, modulo 20, nulls as one space.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    """
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    case = F.pmod(F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"])), F.lit(20))
    text = F.when(case == 1, "").when(case == 2, F.translate(spaced["text"], ".!?", "")).otherwise(spaced["text"])
    role = F.when(case == 4, "user").otherwise(spaced["role"])
    copies = F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(case != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
