"""Conversation structure repair by survivor-coalescence Viterbi (operator 11).

A conversation's rows, in order, are edited so that the initials of their roles read ``(s?(ua)+)?``: each row is kept (0),
given the role user or assistant (2) or deleted (3; a must for blank and repeated rows), and rows with an empty text may be
inserted anywhere (2). A truncated row that stays costs 1 more. Of the cheapest edits those win whose initials (D, I, K, R)
are the least in ASCII order.

The best path to each state of the grammar survives a row. Survivors are leaves of a tree of edits that point back to the
row before; nodes count their children, a node without any is freed, and once the root has a single child all survivors
share it, so its edits are final and go out. Memory thus follows the unresolved rows and not the conversation; where many stay
unresolved, as rows that fit no role can, it holds some bytes of each and their texts wait in a file of the task. Paths of
equal cost are compared by their whole unresolved suffixes: survivors are held in the order of these, and as every suffix
ends with the edit of the row just read, none is the beginning of another, so the order of two extended suffixes is that
of their parents and then that of the letters they add. Survivors that another one beats whatever follows are dropped.
How costs and order of survivors go on depends on their differences only, of which there are few: steps are looked up.

Rows are dealt by conversation, sorted outside memory, and read as a stream, so no conversation is ever held as a group.
Whether a row's role and text were seen before is told by digests within the task in conversations of up to ``SEEN_ROWS``
rows; in longer ones by an aggregation and a salted join over all tasks.

Defined results: a null role or text counts as one space; rows are in order of turn (nulls first), then role, then text;
rows with a null conversation are one conversation; an empty table gives no rows. Other columns are not read.
"""

import hashlib
import pickle
import tempfile
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuelspark.llm.rows import quoted
from fuelspark.operators.scale import salted_pairs

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
# The grammar: nothing yet, a system row, a user's row or an assistant's row last; it may end in ENDS.
START, NEXT, ENDS = "E", {"E": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}, "EA"
SPEAKER = {"u": "user", "a": "assistant"}
# What a survivor in the first state pays at most to end like one in the second, whatever rows follow.
BEHIND = {
    "E": {"S": 0, "U": 2, "A": 0}, "S": {"E": 4, "U": 2, "A": 4}, "U": {"E": 5, "S": 2, "A": 2}, "A": {"E": 3, "S": 0, "U": 2},
}
EDITS = {"K": "Keep", "R": "Rerole", "D": "Delete", "I": "Insert"}
# Rows of a conversation up to which one task tells repeated rows.
SEEN_ROWS = 100_000
# Bytes of unresolved rows that a task holds in memory.
PENDING_BYTES = 16_000_000
# What a step can add to a path.
LETTERS = ["", *["I" * inserts + letter for inserts in range(3) for letter in "DKR"]]
CODES = {letters: code for code, letters in enumerate(LETTERS)}
# Rows and bytes of text that a batch of output holds.
BATCH_ROWS, BATCH_BYTES = 10_000, 4_000_000
FIELDS = "seq bigint, turn bigint, edit string, fault string, cost int, was string, role string, text string"


def reply(state: str) -> str:
    """The one speaker that can follow."""
    return "a" if state == "U" else "u"


@lru_cache(maxsize=100_000)
def step(survivors: tuple[tuple[str, int], ...], initial: str, must_go: bool, truncated: bool):
    """Survivors after a row, in the order of their suffixes, and of each the place of its parent and the letters added.

    ``survivors`` are pairs of a state and a cost above the least one.
    """
    best = {}
    for place, (state, cost) in enumerate(survivors):
        for inserts in range(3):
            letters = "I" * inserts
            moves = [("D", state, DELETE)]
            if not must_go:
                stays = TRUNCATED if truncated else 0
                moves.append(("R", NEXT[state][reply(state)], REROLE + stays))
                if initial in NEXT[state]:
                    moves.append(("K", NEXT[state][initial], KEEP + stays))
            for letter, to, price in moves:
                found = (cost + price, place, letters + letter)
                if to not in best or found < best[to]:
                    best[to] = found
            state, cost = NEXT[state][reply(state)], cost + INSERT
    alive = {s: f for s, f in best.items() if not any(f[0] > best[t][0] + BEHIND[t][s] for t in best if t != s)}
    least = min(f[0] for f in alive.values())
    order = sorted(alive, key=lambda s: alive[s][1:])
    return tuple((s, alive[s][0] - least) for s in order), [alive[s][1:] for s in order]


class Pending:
    """Rows that wait for their edits, first in, first out. Beyond a number of bytes they wait in a file of the task, which
    is gone with it, as do the rows that Spark sorts."""

    def __init__(self):
        self.held: deque = deque()
        self.bytes = self.stored = self.read_at = self.write_at = 0
        self.file = None

    def __len__(self) -> int:
        return len(self.held) + self.stored

    def append(self, row: tuple) -> None:
        size = len(row[2]) + 100
        if not self.stored and self.bytes + size <= PENDING_BYTES:
            self.held.append(row)
            self.bytes += size
            return
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(self.write_at)
        pickle.dump(row, self.file)
        self.write_at, self.stored = self.file.tell(), self.stored + 1

    def popleft(self) -> tuple:
        if self.held:
            row = self.held.popleft()
            self.bytes -= len(row[2]) + 100
            return row
        self.file.seek(self.read_at)
        row = pickle.load(self.file)
        self.read_at, self.stored = self.file.tell(), self.stored - 1
        if not self.stored:
            self.read_at = self.write_at = 0
            self.file.truncate(0)
        return row


class Repair:
    """One conversation: a row goes in by ``add``, final edits come to ``ready`` by ``settle``, the last ones by ``finish``."""

    def __init__(self):
        self.survivors: tuple[tuple[str, int], ...] = ((START, 0),)
        self.leaves, self.root, self.free = [0], 0, []
        # nodes of the tree, some bytes each: they may be as many as the rows where nothing resolves
        self.parent, self.children, self.child_sum, self.codes = array("q", [-1]), array("b", [0]), array("q", [0]), array("b", [0])
        self.rows = Pending()
        self.ready: list[tuple] = []
        self.state, self.seq = START, 0

    def _node(self, parent: int, letters: str) -> int:
        if self.free:
            node = self.free.pop()
            self.parent[node], self.children[node], self.child_sum[node], self.codes[node] = parent, 0, 0, CODES[letters]
        else:
            node = len(self.parent)
            self.parent.append(parent), self.children.append(0), self.child_sum.append(0), self.codes.append(CODES[letters])
        self.children[parent] += 1
        self.child_sum[parent] += node
        return node

    def _release(self, node: int) -> None:
        while self.children[node] == 0 and node != self.root:
            parent = self.parent[node]
            self.children[parent] -= 1
            self.child_sum[parent] -= node
            self.free.append(node)
            node = parent

    def _out(self, letter: str, row: tuple | None) -> None:
        """The edit as (seq, turn, edit, fault, cost, old role, new role, text)."""
        turn, role, text, fault = row or (None, None, "", None)
        late = TRUNCATED if fault == "truncated" else 0
        if letter == "D":
            made = (turn, EDITS[letter], fault, DELETE, role, None, None)
        else:
            speaker = role[:1] if letter == "K" else reply(self.state)
            self.state = NEXT[self.state][speaker]
            cost = {"K": KEEP + late, "R": REROLE + late, "I": INSERT}[letter]
            made = (turn, EDITS[letter], fault, cost, role, role if letter == "K" else SPEAKER[speaker], text)
        self.ready.append((self.seq, *made))
        self.seq += 1

    def _resolve(self, letters: str) -> None:
        for letter in letters[:-1]:
            self._out(letter, None)
        self._out(letters[-1], self.rows.popleft())

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        ending = text.rstrip(SPACE)
        fault = "blank" if not ending else "duplicate" if repeated else "truncated" if ending[-1] not in ".!?" else None
        self.rows.append((turn, role, text, fault))
        self.survivors, came = step(self.survivors, role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        old, self.leaves = self.leaves, [self._node(self.leaves[place], letters) for place, letters in came]
        for leaf in old:
            self._release(leaf)

    def settle(self) -> Iterator[None]:
        """Edits that all survivors share, those of one row at a time."""
        while self.children[self.root] == 1:  # coalesced: the only child is on every survivor's path
            child = self.child_sum[self.root]
            self.free.append(self.root)
            self.root = child
            self._resolve(LETTERS[self.codes[child]])
            yield

    def finish(self) -> Iterator[None]:
        """The edits that are left, those of one row at a time."""
        closing = {"E": 0, "A": 0, "U": 1, "S": 2}
        _, place, inserts = min((cost + INSERT * closing[state], place, closing[state]) for place, (state, cost) in enumerate(self.survivors))
        path, node = array("b"), self.leaves[place]
        while node != self.root:
            path.append(self.codes[node])
            node = self.parent[node]
        for code in reversed(path):
            self._resolve(LETTERS[code])
            yield
        for _ in range(inserts):
            self._out("I", None)
        yield


def _stream(batches: Iterator[pa.RecordBatch], key_type: pa.DataType, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Edits of sorted rows: conversation, turn, role, text and, if it is known, whether the row was seen before."""
    keys, made, size = [], [], 0

    def take(work, key):
        nonlocal size
        for row in work.ready:
            size += len(row[-1] or "")
        keys.extend([key] * len(work.ready))
        made.extend(work.ready)
        work.ready = []

    def batch():
        columns = list(zip(*made, strict=True))
        arrays = [pa.array(keys, key_type), *[pa.array(c, f.type) for c, f in zip(columns, list(fields)[1:], strict=True)]]
        return pa.RecordBatch.from_arrays(arrays, schema=fields)

    def taken(work, key):
        """Ready edits into the batch, which goes out when it is full."""
        nonlocal keys, made, size
        take(work, key)
        if len(made) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            keys, made, size = [], [], 0

    work, current, last, seen = None, None, None, set()
    for rows in batches:
        for key, turn, role, text, again in zip(*[c.to_pylist() for c in rows.columns], strict=True):
            if work is None or key != current:
                if work is not None:
                    for _ in work.finish():
                        yield from taken(work, current)
                work, current, last, seen = Repair(), key, None, set()
            if again is None:
                digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                again = digest in seen
                seen.add(digest)
            else:
                again, last = again or (turn, role, text) == last, (turn, role, text)
            work.add(turn, role, text, again)
            for _ in work.settle():
                yield from taken(work, current)
    if work is not None:
        for _ in work.finish():
            yield from taken(work, current)
    if made:
        yield batch()


def _seen_before(rows: DataFrame, seen_rows: int) -> DataFrame:
    """The rows with ``again``: null in short conversations, else whether an earlier turn had this role and text."""
    unknown = F.lit(None).cast("boolean").alias("again")
    long = rows.groupBy("conversation").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > seen_rows).select(F.col("conversation").alias("_long"))
    if long.isEmpty():
        return rows.select("*", unknown)
    same = F.col("conversation").eqNullSafe(F.col("_long"))
    short = rows.join(long, same, "left_anti").select("*", unknown)
    # a join key per role and text of a conversation; a null turn is before all others
    key = F.sha2(F.to_json(F.struct(F.col("conversation").cast("string"), "role", "text")), 256)
    held = rows.join(long, same, "left_semi").withColumns({"_key": key, "_at": F.struct(F.col("turn").isNotNull().alias("known"), "turn")})
    first = held.groupBy("_key").agg(F.min("_at").alias("_first"))
    flagged = salted_pairs(held, first, ["_key"], "turn")
    return short.unionByName(flagged.select("conversation", "turn", "role", "text", (F.col("_at") != F.col("_first")).alias("again")))


def repair(
    df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", seen_rows: int | None = None,
) -> DataFrame:
    """The edits of each conversation in order: conversation, seq, turn, edit, fault, cost, the role before and the role
    and text after it. Deleted rows have no role and text after; rows other than those are the repaired conversation.
    """
    space = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" "))
    rows = df.select(F.col(quoted(id_col)).alias("conversation"), F.col(quoted(turn_col)).cast("bigint").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    rows = _seen_before(rows, SEEN_ROWS if seen_rows is None else seen_rows)
    dealt = rows.repartition("conversation").sortWithinPartitions("conversation", "turn", "role", "text")
    schema = T.StructType([T.StructField("conversation", df.schema[id_col].dataType), *T._parse_datatype_string(FIELDS).fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        yield from _stream(batches, fields.field(0).type, fields)

    return dealt.mapInArrow(run, schema)


def _summary(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A row per conversation out of its edits in order; nothing is held but the letters of the edits."""
    current, out = None, None
    for key, turn, edit, fault, cost, was, role, text in rows:
        if out is None or key != current:
            if out is not None:
                yield current, *_closed(out)
            current, out = key, {"low": None, "last": None, "distinct": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": bytearray(), "was": None, "sha": hashlib.sha256(), "n": 0}
        out["cost"] += cost
        out["audit"] += edit[:1].encode()
        if edit != "Insert":
            if turn is not None and turn != out["last"]:
                out["low"] = turn if out["low"] is None else out["low"]
                out["last"], out["distinct"] = turn, out["distinct"] + 1
            if fault:
                out[fault] += 1
            out["illegal"] += out["was"] is not None and out["was"] + was[:1] not in ("su", "ua", "au")
            out["was"] = was[:1]
        if edit != "Delete":
            out["sha"].update((("\n" if out["n"] else "") + f"{role}:{text}").encode())
            out["n"] += 1
    if out is not None:
        yield current, *_closed(out)


def _closed(out: dict) -> tuple:
    gaps = 0 if out["low"] is None else out["last"] - out["low"] + 1 - out["distinct"]
    return gaps, *[out[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")], out["audit"].decode(), out["sha"].hexdigest()


DIGEST = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def digests(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s edits, read in the order in which that gives them."""
    schema = T.StructType([edits.schema["conversation"], *T._parse_datatype_string(DIGEST).fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        fields, made = to_arrow_schema(schema), []
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for row in _summary(rows):
            made.append(row)
            if len(made) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), fields, strict=True)], schema=fields)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), fields, strict=True)], schema=fields)

    return edits.select("conversation", "turn", "edit", "fault", "cost", "was", "role", "text").mapInArrow(run, schema)


def _remainder(conv: Column, turn: Column) -> Column:
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults, by a checksum of conversation and turn."""
    kind = _remainder(F.col("conv_id"), F.col("turn"))
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(space("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def repaired_digests(conversations: DataFrame, seen_rows: int | None = None) -> DataFrame:
    """The damaged conversations' digests, with a row of zeros for each conversation that lost all its rows."""
    found = digests(repair(damaged(conversations), seen_rows=seen_rows))
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(found, ids["conv_id"].eqNullSafe(found["conversation"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def _longer(path: str, cost: str, letters: str) -> str:
    """A path of the SQL with more cost and letters. A path is its cost in eight digits and then its letters, so the least
    string is the cheapest and then the least path."""
    return f"(lpad(CAST(CAST(substr({path}, 1, 8) AS INTEGER) + {cost} AS VARCHAR), 8, '0') || substr({path}, 9) || '{letters}')"


# The crc32 is that of the usual reversed polynomial, bit by bit.
ORACLE_SQL = f"""
WITH RECURSIVE keyed AS (
 SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
checked AS (
 SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS kind FROM keyed),
damaged AS (
 SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM checked WHERE kind <> 0),
placed AS (
 SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM damaged),
faults AS (
 SELECT *, CASE WHEN rtrim(text, e' \\t\\n\\x0b\\x0c\\r') = '' THEN 'blank'
   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
   WHEN right(rtrim(text, e' \\t\\n\\x0b\\x0c\\r'), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before
 FROM placed),
steps AS (
 SELECT conv_id, 0::BIGINT AS n, '00000000' AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a
 FROM (SELECT DISTINCT conv_id FROM faults)
 UNION ALL
 SELECT conv_id, n, {_longer('e', '3', 'D')},
  least({_longer('s', '3', 'D')}, CASE WHEN keeps AND c = 's' THEN {_longer('e', 'late', 'K')} END),
  least({_longer('u2', '3', 'D')}, CASE WHEN keeps THEN {_longer('least(e, s, a2)', '2 + late', 'R')} END, CASE WHEN keeps AND c = 'u' THEN {_longer('least(e, s, a2)', 'late', 'K')} END),
  least({_longer('a2', '3', 'D')}, CASE WHEN keeps THEN {_longer('u2', '2 + late', 'R')} END, CASE WHEN keeps AND c = 'a' THEN {_longer('u2', 'late', 'K')} END)
 FROM (SELECT t.conv_id, f.n, f.c, f.fault IN ('', 'truncated') AS keeps, CASE WHEN f.fault = 'truncated' THEN 1 ELSE 0 END AS late, e, s,
   least(u, {_longer('e', '2', 'I')}, {_longer('s', '2', 'I')}, {_longer('a', '2', 'I')}) AS u2,
   least(a, {_longer('u', '2', 'I')}, {_longer('e', '4', 'II')}, {_longer('s', '4', 'II')}) AS a2
  FROM steps t JOIN faults f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.n = t.n + 1)),
best AS (
 SELECT conv_id, least(e, a, {_longer('u', '2', 'I')}, {_longer('s', '4', 'II')}) AS path FROM steps t
 WHERE n = (SELECT max(n) FROM faults f WHERE f.conv_id IS NOT DISTINCT FROM t.conv_id)),
audits AS (SELECT conv_id, CAST(substr(path, 1, 8) AS BIGINT) AS cost, substr(path, 9) AS audit FROM best),
letters AS (
 SELECT conv_id, audit, i, substr(audit, i, 1) AS letter, length(regexp_replace(audit, 'D', '', 'g')) AS stays,
  length(regexp_replace(substr(audit, 1, i), 'I', '', 'g')) AS n, length(regexp_replace(substr(audit, 1, i), 'D', '', 'g')) AS place
 FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM audits)),
repaired AS (
 SELECT l.conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN f.role WHEN (place + stays) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
  CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY i)) AS sha
 FROM letters l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.n WHERE letter <> 'D' GROUP BY l.conv_id),
counts AS (
 SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (n > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
 coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits ON audits.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM o.conv_id
"""

