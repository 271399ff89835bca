"""Cheapest repair of damaged conversations by a grammar-compressed dynamic program.

A row is a symbol: the initial of its role and its fault. Repairing a run of symbols moves between
four states (nothing yet, behind a system row, behind a user row, behind an assistant row), so a run
is a 4 x 4 matrix whose cells hold the least cost from state to state and, as a rope, the letters of
the edits; runs are put together by the min-plus product, the ASCII-least letters winning ties.
Letters of one cell that cost the same are never each other's beginning (they would differ by
inserts, which cost), so the least of a whole is made of the least of its parts.

Symbol strings are compressed by Re-Pair: the commonest adjacent pairs over all conversations become
rules, several a round, counted on distinct strings. A rule's matrix is the product of its two
symbols' and is made once, bottom-up, for all conversations; a conversation multiplies the matrices
of its compressed string.

Rows are dealt by range of (conversation, turn), so that one conversation of any size is spread over
tasks in fragments of bounded size. A conversation that lies in one fragment is finished there. Of
the others each fragment gives its matrix, and one pass over a conversation's fragments chooses the
path; it keeps only costs, letters and running digests, one per state.

Defined cases: null text or role is one space, null ids and turns are one space where rows are
damaged; rows of one turn come by role, then by text digest and text, nulls first; rows with a null
conv_id are one conversation; equal rows are rows of their own; roles other than system, user and
assistant are kept nowhere, unless their initial is one of those; a conversation without rows after
damage gives zeros, an empty audit and the digest of nothing; a text of any length is used whole; an
empty table gives an empty one; other input columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from farelens.llm.common import store

# Fixed values of the contract.
RETAG_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
KEEP, RETAG, DELETE, INSERT = "KRDI"
USER, ASSISTANT = "user", "assistant"
LEGAL = ("su", "ua", "au")
ASCII_SPACE = " \t\n\x0b\f\r"

START, SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STATES = range(4)
# State behind a row with that initial, and the states it may follow.
MOVES = {"s": (SYSTEM, (START,)), "u": (AFTER_USER, (START, SYSTEM, AFTER_ASSISTANT)), "a": (AFTER_ASSISTANT, (AFTER_USER,))}
# Inserts between rows; those that come back to where they began only cost.
INSERTS = {
    **{(q, q): 0 for q in STATES},
    (START, AFTER_USER): 1, (START, AFTER_ASSISTANT): 2, (SYSTEM, AFTER_USER): 1, (SYSTEM, AFTER_ASSISTANT): 2,
    (AFTER_USER, AFTER_ASSISTANT): 1, (AFTER_ASSISTANT, AFTER_USER): 1,
}
# Symbols: must go; small letters are sound, capitals truncated; o is any other initial.
GONE, SYMBOLS = "x", "xsuaoSUAO"
FIRST_RULE = 0x100

ROUNDS = 6
RULES_A_ROUND = 8
FRAGMENT_ROWS = 4096
FRAGMENT_CHARS = 2_000_000

FRAGMENT = (
    "conv_id string, part long, whole boolean, symbols string, roles array<string>, texts array<string>,"
    " low_turn string, high_turn string, turns long, blank long, duplicate long, truncated long, illegal long"
)
REPAIRED = (
    "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
    " repaired_sha256 string"
)
MATRIX = "cells array<struct<p:int,q:int,cost:long,audit:string>>"


def named(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


# -- damage and faults, built in ---------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after damage; dropped ones stay as ``dropped``, without role and text."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    hurt = (
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    gone = F.col("kind") == 0
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.select(
        "conv_id", "turn", gone.alias("dropped"),
        F.when(~gone, F.when(F.col("kind") == 4, F.lit(USER)).otherwise(F.col("role"))).alias("role"),
        F.when(~gone, hurt).alias("text"),
        copies.alias("copy"),
    ).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Add ``fault``: blank, duplicate, truncated or null, the first that holds."""
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim("text", F.lit(ASCII_SPACE))
    fault = (
        F.when(F.col("dropped"), F.lit(None))
        .when(bare == "", "blank")
        .when(F.row_number().over(same) > 1, "duplicate")
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return rows.withColumn("fault", fault)


def symbol() -> Column:
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return (
        F.when(F.col("fault").isin("blank", "duplicate"), GONE)
        .when(F.col("fault") == "truncated", F.upper(known))
        .otherwise(known)
    )


def in_order(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows by conversation, turn, role and text, in ranges of about equal size."""
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text_hash")]
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    return hashed.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys, F.col("text").asc_nulls_first())


# -- fragments -----------------------------------------------------------------


class Fragment:
    """Rows of one conversation that follow each other, gathered up to a bound."""

    def __init__(self, conv_id: str | None, first: bool):
        self.conv_id, self.first = conv_id, first
        self.symbols, self.roles, self.texts, self.turns = [], [], [], []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.chars = 0

    def add(self, row) -> None:
        if row.dropped:
            return
        self.symbols.append(row.symbol)
        self.roles.append(row.role)
        self.texts.append(row.text)
        self.chars += len(row.text)
        if row.turn is not None and (not self.turns or self.turns[-1] != row.turn):
            self.turns.append(row.turn)
        if row.fault:
            self.faults[row.fault] += 1

    def full(self) -> bool:
        return len(self.symbols) >= FRAGMENT_ROWS or self.chars >= FRAGMENT_CHARS

    def row(self, part: int, whole: bool) -> tuple:
        low, high = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        return (
            self.conv_id, part, whole, "".join(self.symbols), self.roles, self.texts, low, high, len(self.turns),
            *self.faults.values(), illegal([r[:1] for r in self.roles]),
        )


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of a task to rows of ``FRAGMENT``. A task's first and last conversation may go on elsewhere."""
    part = TaskContext.get().partitionId() << 32
    current, out, chars = None, [], 0
    for rows in batches:
        turns = rows["turn"].where(rows["turn"].notna(), None)
        for row in rows.assign(turn=turns).itertuples():
            if current is None or row.conv_id != current.conv_id:
                if current is not None:
                    out.append(current.row(part, not current.first))
                    part, chars = part + 1, chars + current.chars
                current = Fragment(row.conv_id, first=current is None)
            elif current.full():
                out.append(current.row(part, False))
                part, chars = part + 1, chars + current.chars
                current = Fragment(row.conv_id, first=True)
            current.add(row)
            if chars > 8 * FRAGMENT_CHARS:
                yield pd.DataFrame(out, columns=named(FRAGMENT))
                out, chars = [], 0
    if current is not None:
        out.append(current.row(part, False))
    if out:
        yield pd.DataFrame(out, columns=named(FRAGMENT))


# -- the grammar -----------------------------------------------------------------


def learn_rules(cut: DataFrame, rounds: int, a_round: int) -> list[str]:
    """Re-Pair over the distinct symbol strings: pairs that become symbols, the n-th being ``FIRST_RULE + n``."""
    strings = store(cut.filter(F.length("symbols") > 1).groupBy("symbols").agg(F.count("*").alias("n")), "symbols")
    rules: list[str] = []
    for _ in range(rounds):
        letters = F.split(compressed(F.col("symbols"), rules), "")
        coded = strings.select("n", letters.alias("s"))
        pairs = F.transform(F.slice("s", F.lit(1), F.size("s") - 1), lambda c, i: F.concat(c, F.get("s", i + 1)))
        counted = coded.filter(F.size("s") > 1).select("n", F.explode(pairs).alias("pair")).groupBy("pair")
        best = counted.agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair").limit(a_round)
        found = [r["pair"] for r in best.collect()]  # at most ``a_round`` pairs
        if not found:
            break
        rules += found
    return rules


def compressed(symbols: Column, rules: list[str]) -> Column:
    for n, pair in enumerate(rules):
        symbols = F.replace(symbols, F.lit(pair), F.lit(chr(FIRST_RULE + n)))
    return symbols


class Rope:
    """Letters of edits as two ropes or a string; written out when first asked for."""

    __slots__ = ("left", "right", "written")

    def __init__(self, written: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.written = left, right, written

    def text(self) -> str:
        if self.written is None:
            parts, open_ = [], [self]
            while open_:
                rope = open_.pop()
                if rope.written is None:
                    open_ += [rope.right, rope.left]
                else:
                    parts.append(rope.written)
            self.written, self.left, self.right = "".join(parts), None, None
        return self.written


Cell = tuple[int, Rope]
Matrix = dict[tuple[int, int], Cell]
NOTHING = Rope("")


def better(new: Cell, old: Cell | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and new[1].text() < old[1].text())


def product(left: Matrix, right: Matrix) -> Matrix:
    """Min-plus product; among equals the ASCII-least letters."""
    out: Matrix = {}
    for (p, k), (cost, rope) in left.items():
        for q in STATES:
            if (then := right.get((k, q))) is None:
                continue
            cell = (cost + then[0], Rope(left=rope, right=then[1]))
            if better(cell, out.get((p, q))):
                out[p, q] = cell
    return out


def inserts() -> Matrix:
    return {at: (INSERT_COST * n, Rope(INSERT * n)) for at, n in INSERTS.items()}


def row_matrix(symbol: str) -> Matrix:
    """Inserts before a row, then what may be done with it."""
    ops: Matrix = {(q, q): (DELETE_COST, Rope(DELETE)) for q in STATES}
    if symbol != GONE:
        cut = TRUNCATED_COST if symbol.isupper() else 0
        for initial, (q, froms) in MOVES.items():
            for p in froms:
                if symbol.lower() == initial:
                    ops[p, q] = (cut, Rope(KEEP))
                elif initial != "s":
                    ops[p, q] = (RETAG_COST + cut, Rope(RETAG))
    return product(inserts(), ops)


class Grammar:
    """Matrices of all symbols, and what whole strings of them cost."""

    def __init__(self, rules: list[str]):
        self.rules = rules

    @cached_property
    def matrices(self) -> dict[str, Matrix]:
        made = {s: row_matrix(s) for s in SYMBOLS}
        for n, (left, right) in enumerate(self.rules):
            made[chr(FIRST_RULE + n)] = product(made[left], made[right])
        for matrix in made.values():
            for _, rope in matrix.values():
                rope.text()
        return made

    def compress(self, symbols: str) -> str:
        for n, pair in enumerate(self.rules):
            symbols = symbols.replace(pair, chr(FIRST_RULE + n))
        return symbols

    def follow(self, state: int, symbols: str) -> dict[int, tuple[int, str]]:
        """Least cost and letters from a state to every state, over a string of symbols."""
        at: Matrix = {(state, state): (0, NOTHING)}
        for symbol in self.compress(symbols):
            at = product(at, self.matrices[symbol])
        return {q: (cost, rope.text()) for (_, q), (cost, rope) in at.items()}

    def whole(self, symbols: str) -> tuple[int, str]:
        """Least cost and letters of a whole conversation."""
        return finish({q: (cost, letters) for q, (cost, letters) in self.follow(START, symbols).items()})[1:]


def finish(at: dict[int, tuple[int, str]]) -> tuple[int, int, str]:
    """The last inserts: the state they start from, cost and letters."""
    ends = [
        (cost + INSERT_COST * n, letters + INSERT * n, p)
        for (p, q), n in INSERTS.items()
        if q in (START, AFTER_ASSISTANT) and p in at
        for cost, letters in [at[p]]
    ]
    cost, letters, p = min(ends)
    return p, cost, letters


# -- what the edits leave ----------------------------------------------------------


class Repaired:
    """A running digest of ``role:text`` lines."""

    def __init__(self, state: int = START, started: bool = False, digest=None):
        self.state, self.started = state, started
        self.digest = digest or hashlib.sha256()

    def copy(self) -> Repaired:
        return Repaired(self.state, self.started, self.digest.copy())

    def write(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.started else "") + role + ":" + text).encode())
        self.started = True
        self.state = MOVES[role[0]][0]

    def edit(self, letters: str, roles, texts) -> Repaired:
        at = 0
        for letter in letters:
            needed = ASSISTANT if self.state == AFTER_USER else USER
            if letter == INSERT:
                self.write(needed, "")
                continue
            if letter != DELETE:
                self.write(roles[at] if letter == KEEP else needed, texts[at])
            at += 1
        return self


def finished(grammar) -> object:
    """Rows of whole ``FRAGMENT``s to rows of ``REPAIRED``; equal symbol strings are solved once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        solve, known = grammar.value, {}
        for rows in batches:
            out = []
            for row in rows.itertuples():
                if row.symbols not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    known[row.symbols] = solve.whole(row.symbols)
                cost, audit = known[row.symbols]
                digest = Repaired().edit(audit, row.roles, row.texts).digest.hexdigest()
                gaps = int(row.high_turn) - int(row.low_turn) + 1 - row.turns if row.turns else 0
                out.append((row.conv_id, gaps, row.blank, row.duplicate, row.truncated, row.illegal, cost, audit, digest))
            yield pd.DataFrame(out, columns=named(REPAIRED))

    return run


def with_cells(grammar) -> object:
    """Adds its matrix to each fragment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            cells = [
                [
                    {"p": p, "q": q, "cost": cost, "audit": letters}
                    for p in STATES
                    for q, (cost, letters) in grammar.value.follow(p, symbols).items()
                ]
                for symbols in rows["symbols"]
            ]
            yield rows.assign(cells=cells)

    return run


class Path:
    """One conversation's fragments in order: sums, and the best way to each state so far."""

    def __init__(self, conv_id: str | None):
        self.conv_id = conv_id
        self.ways = {START: (0, "", Repaired())}
        self.sums = [0, 0, 0, 0]
        self.low = self.high = self.initial = None
        self.turns = 0

    def add(self, row) -> None:
        ways: dict = {}
        for cell in row.cells:
            if cell["p"] in self.ways:
                cost, letters, _ = self.ways[cell["p"]]
                way = (cost + cell["cost"], letters + cell["audit"], cell["p"], cell["audit"])
                if cell["q"] not in ways or way < ways[cell["q"]]:
                    ways[cell["q"]] = way
        self.ways = {
            q: (cost, letters, self.ways[p][2].copy().edit(own, row.roles, row.texts))
            for q, (cost, letters, p, own) in ways.items()
        }
        self.sums = [a + int(b) for a, b in zip(self.sums, (row.blank, row.duplicate, row.truncated, row.illegal), strict=True)]
        if len(row.roles):
            if self.initial is not None:
                self.sums[3] += self.initial + row.roles[0][:1] not in LEGAL
            self.initial = row.roles[-1][:1]
        if row.turns:
            self.turns += int(row.turns) - (self.high == row.low_turn)
            self.low, self.high = self.low if self.low is not None else row.low_turn, row.high_turn

    def row(self) -> tuple:
        state, cost, letters = finish({q: (cost, letters) for q, (cost, letters, _) in self.ways.items()})
        _, before, repaired = self.ways[state]
        digest = repaired.copy().edit(letters[len(before) :], (), ()).digest.hexdigest()
        gaps = int(self.high) - int(self.low) + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.sums, cost, letters, digest)


def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fragments with matrices, by conversation and part, to rows of ``REPAIRED``."""
    path, out = None, []
    for rows in batches:
        for row in rows.itertuples():
            if path is None or row.conv_id != path.conv_id:
                if path is not None:
                    out.append(path.row())
                path = Path(row.conv_id)
            path.add(row)
        yield pd.DataFrame(out, columns=named(REPAIRED))
        out = []
    if path is not None:
        yield pd.DataFrame([path.row()], columns=named(REPAIRED))


def repair(rows: DataFrame, partitions: int | None = None, rounds: int = ROUNDS, a_round: int = RULES_A_ROUND) -> DataFrame:
    """Faults, cost, letters and digest of the cheapest repair of each conversation, after damage."""
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    faulty = store(with_faults(damaged(rows)), "faulty-turns")
    marked = faulty.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "dropped", "role", "text", "fault",
        symbol().alias("symbol"),
    )
    sorted_ = in_order(marked, partitions).select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"),
        "dropped", "role", "text", "fault", "symbol",
    )
    cut = store(sorted_.mapInPandas(fragments, FRAGMENT), "conversation-fragments")
    grammar = spark.sparkContext.broadcast(Grammar(learn_rules(cut, rounds, a_round)))  # rounds x a_round rules at most
    done = cut.filter("whole").mapInPandas(finished(grammar), REPAIRED)
    open_ = cut.filter("not whole").mapInPandas(with_cells(grammar), f"{FRAGMENT}, {MATRIX}")
    ordered = open_.repartition(partitions, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part")
    out = done.unionByName(ordered.mapInPandas(joined, REPAIRED))
    return out.withColumn("conv_id", F.col("conv_id").cast("long"))
