"""Repair of conversation structure: the cheapest edits that give a conversation its turns in order.

A conversation's rows become symbols: what the row's role begins with, whether it is cut off, or that it
must go (blank, or said before). Edits over such a sequence are a shortest path through four states
(nothing yet, after a system row, after a user row, after an assistant row). Each symbol is a matrix of
4 x 4 costs with the edits behind each, and sequences are min-plus products of matrices.

Re-Pair finds a grammar of all conversations: the pairs of neighbouring symbols that are most frequent in
the corpus become rules, round by round, counted by Spark. Each rule's matrix is the product of its two
parts, computed once, bottom-up; its edits are ropes that share the parts' edits. Every task then
multiplies few matrices for a conversation, and equal sequences only once.

Equal costs are decided by the edits' letters. Of two different edit lists of equal cost none is the
beginning of the other (what follows would be insertions, which cost), so the least stays the least
whatever is put before or behind, and the product of matrices may be bracketed in any way.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topiclake.session import stage

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
# States: nothing yet, after system, after user, after assistant. Where a row or an insertion leads.
STATES = 4
_NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
_TURN = {0: ("user", 2), 1: ("user", 2), 3: ("user", 2), 2: ("assistant", 3)}
_ENDS = (0, 3)
# Symbols of rows: must go; role s, u, a or another one; the same cut off.
SYMBOLS = "dsuaoSUAO"
# Rows of one conversation that make a sequence, and bounds of the grammar.
SEGMENT_BITS = 8
RULES, ROUNDS, LEAST = 256, 12, 2


# ------------------------------------------------------------ ropes and matrices


class Rope:
    """A text of two parts that other ropes share; it is put together when it is asked for."""

    __slots__ = ("left", "right", "_text")

    def __init__(self, left: "Rope | str" = "", right: "Rope | str" = ""):
        self.left, self.right, self._text = left, right, None

    def __str__(self) -> str:
        if self._text is None:
            out, stack = [], [self.right, self.left]
            while stack:
                part = stack.pop()
                if isinstance(part, str):
                    out.append(part)
                elif part._text is not None:
                    out.append(part._text)
                else:
                    stack += (part.right, part.left)
            self._text = "".join(out)
        return self._text


Entry = "tuple[int, Rope | str] | None"
Matrix = "list[list[Entry]]"


def better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if str(a[1]) <= str(b[1]) else b


def product(x: Matrix, y: Matrix) -> Matrix:
    """Min-plus product; of equal costs the least letters."""
    out = []
    for row in x:
        best: list[Entry] = [None] * STATES
        for k, a in enumerate(row):
            if a is not None:
                for j, b in enumerate(y[k]):
                    if b is not None and (best[j] is None or a[0] + b[0] <= best[j][0]):
                        best[j] = better(best[j], (a[0] + b[0], Rope(a[1], b[1])))
        out.append(best)
    return out


def insertions() -> Matrix:
    """Any insertions between two rows; two or fewer lead to every state that insertions reach."""
    out = [[(0, "") if i == j else None for j in range(STATES)] for i in range(STATES)]
    for i in range(STATES):
        state = i
        for n in (1, 2):
            state = _TURN[state][1]
            out[i][state] = better(out[i][state], (INSERT * n, "I" * n))
    return out


def row_matrix(symbol: str) -> Matrix:
    """Insertions, then one edit of a row of this symbol."""
    extra = CUT if symbol.isupper() else 0
    edit: Matrix = [[None] * STATES for _ in range(STATES)]
    for state in range(STATES):
        edit[state][state] = (DELETE, "D")
        if symbol != "d":
            to = _TURN[state][1]
            edit[state][to] = better(edit[state][to], (REROLE + extra, "R"))
            to = _NEXT.get((symbol.lower(), state))
            if to is not None:
                edit[state][to] = better(edit[state][to], (extra, "K"))
    return product(insertions(), edit)


# ------------------------------------------------------------ grammar


@dataclass
class Grammar:
    """Rules in rounds; symbol numbers from ``len(SYMBOLS)`` on are rules, in order."""

    rounds: list[dict[tuple[int, int], int]] = field(default_factory=list)

    def replace(self, symbols: list[int]) -> list[int]:
        """The sequence after all rounds, pairs taken from the left."""
        for rules in self.rounds:
            out, i, last = [], 0, len(symbols) - 1
            while i <= last:
                new = rules.get((symbols[i], symbols[i + 1])) if i < last else None
                out.append(symbols[i] if new is None else new)
                i += 1 if new is None else 2
            if len(out) == len(symbols):
                continue
            symbols = out
        return symbols

    def matrices(self) -> list[Matrix]:
        """One matrix per symbol, rules after their parts."""
        out = [row_matrix(s) for s in SYMBOLS]
        for rules in self.rounds:
            for (x, y), _ in sorted(rules.items(), key=lambda r: r[1]):
                out.append(product(out[x], out[y]))
        return out


def parse(text: str) -> list[int]:
    return [SYMBOLS.index(s) for s in text]


def pair_counts(symbols: Sequence[int]) -> Counter:
    """Neighbouring pairs; of overlapping equal ones, as in ``aaa``, every other one."""
    out: Counter = Counter()
    i = 0
    while i + 1 < len(symbols):
        pair = (symbols[i], symbols[i + 1])
        out[pair] += 1
        i += 2 if pair[0] == pair[1] and symbols[i + 2 : i + 3] == [pair[0]] else 1
    return out


def choose(counts: dict[tuple[int, int], int], room: int) -> list[tuple[int, int]]:
    """The most frequent pairs, none of which shares a symbol with another, so their order is free."""
    used: set[int] = set()
    out = []
    for pair, n in sorted(counts.items(), key=lambda c: (-c[1], c[0])):
        if n >= LEAST and len(out) < room and not used & set(pair):
            out.append(pair)
            used |= set(pair)
    return out


def learn(sequences: DataFrame) -> Grammar:
    """Re-Pair over all rows (symbols): each round counts the pairs of the whole table.

    What reaches the driver is one count per pair of symbols, of which there are at most
    (``len(SYMBOLS) + RULES``) squared, whatever the corpus. Rules repeat at least ``LEAST`` times; a
    grammar without rules is right too.
    """
    grammar = Grammar()
    size = len(SYMBOLS)
    while len(grammar.rounds) < ROUNDS and size < len(SYMBOLS) + RULES:
        known = Grammar(list(grammar.rounds))

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for text, n in Counter(batch.column(0).to_pylist()).items():
                    for pair, m in pair_counts(known.replace(parse(text))).items():
                        total[pair] += n * m
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in total], pa.int32()), pa.array([p[1] for p in total], pa.int32()),
                 pa.array(list(total.values()), pa.int64())], ["x", "y", "n"],
            )

        counts = sequences.select("symbols").mapInArrow(counted, "x int, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
        pairs = choose({(r.x, r.y): r.n for r in counts.collect()}, len(SYMBOLS) + RULES - size)
        if not pairs:
            break
        grammar.rounds.append({pair: size + i for i, pair in enumerate(pairs)})
        size += len(pairs)
    return grammar


# ------------------------------------------------------------ paths


class Path:
    """Cheapest edits from the start to each state, taken in piece by piece.

    What the edits of all states begin with is kept once; only their ends are compared.
    """

    def __init__(self):
        self.done: list[str] = []
        self.row: list[Entry] = [(0, "")] + [None] * (STATES - 1)

    def add(self, matrix: Matrix) -> None:
        row = product([self.row], matrix)[0]
        row = [None if e is None else (e[0], str(e[1])) for e in row]
        ends = [e[1] for e in row if e is not None]
        low, high = min(ends), max(ends)
        n = next((i for i, c in enumerate(low) if high[i : i + 1] != c), len(low))
        self.done.append(low[:n])
        self.row = [None if e is None else (e[0], e[1][n:]) for e in row]

    def end(self) -> tuple[int, str]:
        row = product([self.row], insertions())[0]
        best: Entry = None
        for state in _ENDS:
            best = better(best, row[state])
        return best[0], "".join(self.done) + str(best[1])


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) after the edits; ``rows`` are read as the edits need them."""
    state = 0
    for edit in audit:
        if edit == "I":
            role, state = _TURN[state]
            yield role, ""
            continue
        role, text = next(rows)
        if edit == "R":
            role, state = _TURN[state]
            yield role, text
        elif edit == "K":
            state = _NEXT[role[:1], state]
            yield role, text


# ------------------------------------------------------------ tables


def damaged(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(_conv, _turn, _role, _text, _live) of rows damaged by crc32(``conv:turn``) % 20.

    0 drops the row (it stays here, with ``_live`` false), 1 empties its text, 2 takes out ``.!?``, 3
    repeats it, 4 gives it to the user. Null roles and texts are one space, and so are nulls in the
    text that is hashed.
    """
    def named(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(named(conv), F.lit(":"), named(turn)).cast("binary")) % 20
    rows = df.select(
        F.col(f"`{conv}`").alias("_conv"), F.col(f"`{turn}`").alias("_turn"),
        named(role).alias("_role"), named(text).alias("_text"), kind.alias("_kind"),
    )
    rows = rows.withColumn("_text", F.when(F.col("_kind") == 1, "").when(
        F.col("_kind") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text")))
    rows = rows.withColumn("_role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")))
    rows = rows.withColumn("_live", F.col("_kind") != 0)
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("_copy", F.explode(copies)).drop("_kind", "_copy")


def _facts(rows: DataFrame) -> DataFrame:
    """Rows without texts, in order: (conv, live, turn, role, initial, digest, blank, cut, at).

    Rows of a conversation go by turn, nulls first, then by role and a digest of the text. They are
    range-partitioned, so a conversation of any length is spread over tasks; ``at`` rises along it.
    """
    solid = F.regexp_replace("_text", r"[ \t-\r]+$", "")
    small = rows.select(
        F.col("_conv").alias("conv"), F.col("_live").alias("live"), F.col("_turn").alias("turn"),
        F.col("_role").alias("role"), F.md5("_text").alias("digest"),
        (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"),
    ).withColumn("salt", F.monotonically_increasing_id())
    order = ["conv", "live", F.asc_nulls_first("turn"), "role", "digest", "salt"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = small.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt")
    return stage(placed.withColumn("at", F.monotonically_increasing_id()), "turns")


def _sequences(facts: DataFrame) -> DataFrame:
    """(conv, segment, symbols, initials, ...) of up to 256 neighbouring rows of a conversation.

    ``ahead`` and ``behind`` are the first and last turn, ``turns`` the number of different ones.
    Conversations without rows after damage have one segment without symbols.
    """
    first = facts.filter("live").groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    marked = facts.join(first, "at", "left")
    blank, again = F.col("blank"), F.col("first").isNull()
    role = F.substring("role", 1, 1)
    known = F.when(role.isin("s", "u", "a"), role).otherwise("o")
    symbol = F.when(blank | again, "d").when(F.col("cut"), F.upper(known)).otherwise(known)
    fault = F.when(blank, "b").when(again, "d").when(F.col("cut"), "t").otherwise("-")
    entry = F.struct(
        "at", symbol.alias("s"), F.when(F.col("role") == "", "\0").otherwise(role).alias("r"), fault.alias("f"), F.col("turn").alias("t"),
    )
    segment = F.shiftright("at", SEGMENT_BITS).alias("segment")
    grouped = marked.groupBy("conv", segment).agg(
        F.sort_array(F.collect_list(F.when(F.col("live"), entry))).alias("e")
    )

    def joined(name: str) -> Column:
        return F.array_join(F.transform("e", lambda x: x[name]), "")

    turns = F.array_compact(F.transform("e", lambda x: x["t"]))
    return grouped.select(
        "conv", "segment", joined("s").alias("symbols"), joined("r").alias("initials"), joined("f").alias("faults"),
        F.array_min(turns).alias("ahead"), F.array_max(turns).alias("behind"),
        F.size(F.array_distinct(turns)).cast("long").alias("turns"),
    )


@dataclass
class _Tally:
    """What a conversation's segments add up to, in order."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    ahead: int | None = None
    behind: int | None = None
    last: str = ""
    path: Path = field(default_factory=Path)

    def add(self, symbols: str, initials: str, faults: str, ahead, behind, turns, matrix) -> None:
        self.blank += faults.count("b")
        self.duplicate += faults.count("d")
        self.truncated += faults.count("t")
        along = self.last + initials
        self.illegal += sum(along[i : i + 2] not in ("su", "ua", "au") for i in range(len(along) - 1))
        self.last = along[-1:]
        if turns:
            self.turns += turns - (self.behind == ahead)
            self.ahead = ahead if self.ahead is None else self.ahead
            self.behind = behind
        if symbols:
            self.path.add(matrix)

    @property
    def gaps(self) -> int:
        return 0 if self.ahead is None else self.behind - self.ahead + 1 - self.turns


OUT = [
    ("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"),
    ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string"),
]
_ROW = ("symbols", "initials", "faults", "ahead", "behind", "turns")


class _Results:
    """Reads a task's rows, sorted by conversation; segments come before texts."""

    def __init__(self, grammar: Grammar, matrices: list[Matrix]):
        self.grammar, self.matrices = grammar, matrices
        self.known: dict[str, Matrix] = {}

    def matrix(self, symbols: str) -> Matrix | None:
        if not symbols:
            return None
        if symbols not in self.known:
            parts = self.grammar.replace(parse(symbols))
            out = self.matrices[parts[0]]
            for p in parts[1:]:
                out = product(out, self.matrices[p])
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[symbols] = out
        return self.known[symbols]

    def rows(self, stream: Iterator[dict]) -> Iterator[tuple]:
        """Results of the conversations, one after the other; texts are hashed as they come."""
        row = next(stream, None)
        while row is not None:
            conv, tally = row["conv"], _Tally()
            while row is not None and row["conv"] == conv and not row["part"]:
                tally.add(*(row[c] for c in _ROW), self.matrix(row["symbols"]))
                row = next(stream, None)
            cost, audit = tally.path.end()

            def own() -> Iterator[tuple[str, str]]:
                nonlocal row
                while row is not None and row["conv"] == conv:
                    yield row["role"], row["text"]
                    row = next(stream, None)

            digest, first = hashlib.sha256(), True
            texts = own()
            for role, text in repaired(audit, texts):
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
            for _ in texts:  # nothing is left of a conversation whose edits are spent
                pass
            yield (conv, tally.gaps, tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit, digest.hexdigest())


def repair(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged as :func:`damaged` says, put in order of their turns (nulls first; equal turns by role,
    then by a digest of the text) and each is blank, a duplicate, truncated or none of these. ``audit`` has the
    cheapest edits: Keep, Rerole, Delete, Insert. A role that is an empty text has no initial and cannot be
    kept; other initials than s, u and a cannot either. Null conversations are one. Conversations
    without rows after the damage have zeros, an empty audit and the hash of the empty text. An
    empty table gives an empty one; other columns are not read.

    Only digests are sorted and grouped; the texts are shuffled once, by conversation, and read one
    row at a time. A conversation's texts are hashed in one task, since SHA-256 has to read them in order;
    its edits are worked out from segments of 256 rows.
    """
    rows = damaged(df, conv, turn, role, text)
    segments = stage(_sequences(_facts(rows)), "segments")
    grammar = learn(segments.filter("symbols <> ''"))
    matrices = grammar.matrices()
    live = rows.filter("_live")
    stream = segments.select("conv", F.lit(0).alias("part"), "segment", *_ROW, F.lit(None).cast("long").alias("t"),
                             F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    texts = live.select(
        F.col("_conv").alias("conv"), F.lit(1).alias("part"), F.lit(None).cast("long").alias("segment"),
        *(F.lit(None).cast(segments.schema[c].dataType).alias(c) for c in _ROW),
        F.col("_turn").cast("long").alias("t"), F.col("_role").alias("role"), F.col("_text").alias("text"),
    )
    both = stream.unionByName(texts).repartition("conv")
    both = both.sortWithinPartitions("conv", "part", "segment", F.asc_nulls_first("t"), "role", F.md5("text")).drop("t")

    kinds = {"long": pa.int64(), "string": pa.string()}

    def packed(out: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out))
        arrays = [pa.array(columns[0], conv_type)] + [pa.array(c, kinds[k]) for c, (_, k) in zip(columns[1:], OUT)]
        return pa.RecordBatch.from_arrays(arrays, ["_conv", *(n for n, _ in OUT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type = pa.null()

        def stream() -> Iterator[dict]:
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field("conv").type
                for at in range(0, batch.num_rows, 256):
                    yield from batch.slice(at, 256).to_pylist()

        out, held = [], 0
        for result in _Results(grammar, matrices).rows(stream()):
            out.append(result)
            held += len(result[7]) + 100
            if held > 1 << 20:
                yield packed(out, conv_type)
                out, held = [], 0
        if out:
            yield packed(out, conv_type)

    conv_type = segments.schema["conv"].dataType.simpleString()
    schema = f"_conv {conv_type}, " + ", ".join(f"{n} {k}" for n, k in OUT)
    return both.mapInArrow(run, schema).withColumnRenamed("_conv", conv)
