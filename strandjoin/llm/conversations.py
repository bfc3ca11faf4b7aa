"""Conversation structure repair: cheapest edits that make the roles read `(s?(ua)+)?`.

Rows of a conversation stand by turn (null first), then role, then the SHA-256 of their text. Each
row's first fault counts: blank, duplicate (role and text seen earlier) or truncated. Keep costs
0, Rerole 1, Delete 2 (the only edit of blank and duplicate rows), Insert 5; a truncated row that
is not deleted adds 5. Of the cheapest edits the audit, their initials in order, is ASCII-least.

One integer weighs a path: its high digits are the cost, its low digits the letters of the audit,
first letter highest, three bits each, in a fixed width with zeros behind the last letter. An
edge puts its letters in front of the rest, so the plain minimum of integers, taken backwards
over the graph of (row, state), decides cost and audit at once. Between two states of the same rows
no cheapest audit is the beginning of another: each row gives one letter, and what follows could
only be inserts that return to the same state, which cost more. So the best paths between any
two states of a stretch of rows can be joined to those of the next stretch.

That bounds the work of a task: a conversation is cut into stretches of SEGMENT rows, each solved
for its 4 x 4 pairs of states; FAN neighbours at a time are solved as the edges of one graph, level
by level; then the chosen states go down the same levels to the rows. Only the digest of a
repaired conversation, which SHA-256 defines as one sequence, is taken by one task, which
streams the sorted lines and holds one at a time.

Defined results: a null role or text is one space; a null conv_id is a conversation of its own;
repeated rows are rows; a role counts by its first letter, so that an empty one is never kept; an
empty table gives no rows; other columns are not read. Very long texts are only hashed and
compared by their hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandjoin.llm.common import stage

#: Rows of a stretch, and stretches that one graph joins, as powers of two.
SEGMENT_BITS, FAN_BITS = 8, 6
#: What counts as white space.
BLANKS = " \t\n\x0b\x0c\r"
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
STATES = 4
MATRIX = "costs array<bigint>, audits array<string>, routes array<string>"


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that crc32 of `conv_id:turn` modulo 20 names."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.pmod(F.crc32(F.concat_ws(":", *shown).cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", ""))
    times = F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))
    return rows.where("fate != 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(times).alias("copy"),
    ).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest and pos: rows of a conversation have neighbouring numbers.

    Range partitions count their rows; the counts before a partition are added to its numbers.
    """
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit(" ")), 256)).alias("digest")
    keyed = rows.select("conv_id", "turn", role, text, digest, F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", "turn", "role", "digest", "row"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    part = F.spark_partition_id().alias("part")
    ranged = stage(ranged.select("*", part, F.monotonically_increasing_id().alias("row")), "turns")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row0"))
    # One row for each partition of the table above, whatever the number of its rows.
    listed = sorted((r["part"], r["n"], r["row0"]) for r in counts.collect())
    begins, n0 = [], 0
    for number, n, row0 in listed:
        begins.append((number, n0 - row0))
        n0 += n
    starts = rows.sparkSession.createDataFrame(begins, "part int, shift bigint")
    numbered = ranged.join(F.broadcast(starts), "part")
    return numbered.withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def find_faults(ordered: DataFrame) -> DataFrame:
    """Add fault: blank, duplicate, truncated or null.

    The first row of each (conversation, role, text) comes from an aggregate; it is marked by a
    join on its own number, so that a text that many rows repeat is no hot key.
    """
    firsts = ordered.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos"))
    marked = ordered.join(firsts.select("pos", F.lit(True).alias("first")), "pos", "left")
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(trimmed == "", "blank")
        .when(F.col("first").isNull(), "duplicate")
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
    )
    return marked.withColumn("fault", fault).drop("first")


def row_edges(code: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit letters) of every edit of one row.

    code: s, u, a or x (another role), in capitals if the row is truncated, or - if it must go. At
    most two inserts stand before a row: a third would return to a state at a cost.
    """
    follows = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(code.lower(), {})
    more = 5 if code.isupper() else 0
    edges = []
    for before in range(STATES):
        at = before
        for inserts in range(3):
            lead, cost = "I" * inserts, 5 * inserts
            edges.append((before, at, cost + 2, lead + "D"))
            if code != "-":
                edges.append((before, follows[at], cost + 1 + more, lead + "R"))
                if at in kept:
                    edges.append((before, kept[at], cost + more, lead + "K"))
            at = follows[at]
    return edges


#: How a conversation may end, as edges to state 0: what lacks an answer gets inserts.
END = [(0, 0, 0, ""), (3, 0, 0, ""), (2, 0, 5, "I"), (1, 0, 10, "II")]
LETTERS, DIGITS = "DIKR", "1234"


def solver() -> Callable[[list], tuple[list, list, list]]:
    """A function of a list of edge lists, one for each step of a graph.

    It returns costs (-1: no path), audits and routes (the states passed, as digits) for the 16
    pairs of a first and a last state.
    """
    code, name = str.maketrans(LETTERS, DIGITS), str.maketrans(DIGITS, LETTERS)

    def solve(steps: list) -> tuple[list, list, list]:
        width = 3 * (sum(max((len(e[3]) for e in edges), default=0) for edges in steps) + 1)
        low = (1 << width) - 1
        weighed = [
            [(p, r, (c << width) + (int(s.translate(code) or "0", 8) << width - 3 * len(s)), 3 * len(s)) for p, r, c, s in edges]
            for edges in steps
        ]
        costs, audits, routes = [-1] * 16, [""] * 16, [""] * 16
        for last in range(STATES):
            best = {last: 0}
            choices = []
            for edges in reversed(weighed):
                found: dict = {}
                for p, r, own, bits in edges:
                    if r in best:
                        rest = best[r]
                        weight = own + (rest - (rest & low)) + ((rest & low) >> bits)
                        if p not in found or weight < found[p][0]:
                            found[p] = (weight, r)
                best = {p: w for p, (w, _) in found.items()}
                choices.append({p: r for p, (_, r) in found.items()})
            for first, weight in best.items():
                at, route = first, [first]
                for choice in reversed(choices):
                    at = choice[at]
                    route.append(at)
                pair = first * STATES + last
                costs[pair] = weight >> width
                audits[pair] = f"{weight & low:o}".zfill(width // 3).rstrip("0").translate(name)
                routes[pair] = "".join(map(str, route))
        return costs, audits, routes

    return solve


def matrix_edges(costs: list, audits: list) -> list[tuple[int, int, int, str]]:
    """The pairs of states of a solved stretch as edges."""
    return [(i // STATES, i % STATES, c, audits[i]) for i, c in enumerate(costs) if c >= 0]


def solve_leaves(leaves: DataFrame) -> DataFrame:
    """Add the matrix of every stretch, from its codes. Equal codes are solved once in a batch."""
    solve = solver()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = {c: row_edges(c) for c in "suaxSUAX-"}
        for batch in batches:
            codes = batch.column("codes").to_pylist()
            solved = {c: solve([edges[x] for x in c]) for c in set(codes)}
            yield with_matrix(batch, [solved[c] for c in codes])

    return leaves.mapInArrow(run, f"{_fields(leaves)}, {MATRIX}")


def solve_parents(parents: DataFrame) -> DataFrame:
    """Add the matrix of every group of neighbours, from steps: (node, costs, audits) in order."""
    solve = solver()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                batch = whole.slice(i, 1)
                steps = [matrix_edges(c["costs"], c["audits"]) for c in batch.column("steps")[0].as_py()]
                kept = batch.select([n for n in batch.schema.names if n != "steps"])
                yield with_matrix(kept, [solve(steps)])

    return parents.mapInArrow(run, f"{_fields(parents.drop('steps'))}, {MATRIX}")


def solve_ends(roots: DataFrame) -> DataFrame:
    """Add cost, audit and route (first and last state) of whole conversations."""
    solve = solver()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for costs, audits in zip(batch.column("costs").to_pylist(), batch.column("audits").to_pylist()):
                c, a, r = solve([matrix_edges(costs, audits), END])
                found.append((c[0], a[0], r[0][:2]))
            kept = batch.select([n for n in batch.schema.names if n not in ("costs", "audits")])
            more = [pa.array([f[0] for f in found], pa.int64()), *[pa.array([f[i] for f in found], pa.string()) for i in (1, 2)]]
            yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*kept.schema.names, "cost", "audit", "route"])

    return roots.mapInArrow(run, f"{_fields(roots.drop('costs', 'audits'))}, cost bigint, audit string, route string")


def _fields(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)


def with_matrix(batch: pa.RecordBatch, solved: list) -> pa.RecordBatch:
    kinds = (pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))
    more = [pa.array([s[i] for s in solved], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "costs", "audits", "routes"])


def illegal_pairs(initials: Column) -> Column:
    """Neighbours in a string of initials other than su, ua and au."""
    # A pair is one character and the one it looks at, so that pairs overlap.
    return (F.length(initials) - 1 - F.regexp_count(initials, F.lit("s(?=u)|u(?=a)|a(?=u)"))).cast("long")


def same_conversation(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    condition = a["conv_id"].eqNullSafe(b["conv_id"])
    for key in keys:
        condition = condition & (a[key] == b[key])
    return condition


def plan_repairs(rows: DataFrame, segment_bits: int = SEGMENT_BITS, fan_bits: int = FAN_BITS) -> tuple[DataFrame, DataFrame]:
    """Per conversation with rows its counts, cost and audit; and the rows with their edits.

    rows: conv_id, turn, role, text. The second table has pos, conv_id, role, text, fault, state
    (before the row) and edit (inserts before the row and the row's own letter); it ends, for
    each conversation that needs them, with a row without role for the last inserts.
    """
    found = stage(find_faults(in_order(rows)), "faults")
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    by_turn = found.groupBy("conv_id", "turn").agg(
        F.min("pos").alias("begin"), F.count(F.lit(1)).alias("n"), *[count(x) for x in ("blank", "duplicate", "truncated")]
    )
    distinct = F.count("turn")
    span = F.max("turn") - F.min("turn") + 1 - distinct
    totals = by_turn.groupBy("conv_id").agg(
        F.min("begin").alias("begin"),
        F.sum("n").alias("n"),
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")],
    )
    totals = stage(totals, "conversations")

    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    starts = totals.select("conv_id", "begin", F.shiftright(F.col("n") - 1, segment_bits).alias("last"))
    narrow = found.select("conv_id", "pos", F.struct("pos", code.alias("code"), initial.alias("initial")).alias("row"))
    placed = narrow.join(starts, same_conversation(narrow, starts)).drop(starts["conv_id"])
    node = F.shiftright(F.col("pos") - F.col("begin"), segment_bits)
    grouped = placed.groupBy("conv_id", "begin", "last", node.alias("node")).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    text = lambda field: F.array_join(F.transform("rows", lambda r: r[field]), "")
    leaves = grouped.select("conv_id", "begin", "last", "node", text("code").alias("codes"), text("initial").alias("initials"))
    leaves = leaves.select(
        "*",
        illegal_pairs(F.col("initials")).alias("illegal"),
        F.substring("initials", 1, 1).alias("first_initial"),
        F.substring("initials", -1, 1).alias("last_initial"),
    )
    levels = [stage(solve_leaves(leaves.drop("initials")), "level-0")]
    longest = levels[0].agg(F.max("last")).first()[0] or 0
    while longest > 0:
        levels.append(stage(solve_parents(_parents(levels[-1], fan_bits)), f"level-{len(levels)}"))
        longest >>= fan_bits

    ends = []
    for level in levels:
        alone = level.where("last = 0").select("conv_id", "begin", "illegal", "costs", "audits")
        ends.append(solve_ends(alone))
    whole = ends[0]
    for more in ends[1:]:
        whole = whole.unionByName(more)
    whole = stage(whole, "ends")
    # begin names a conversation, a null one too.
    summary = totals.join(whole.select("begin", "illegal", "cost", "audit"), "begin").drop("begin", "n")
    return summary, _edited_rows(found, levels, whole, totals, segment_bits, fan_bits)


def _parents(level: DataFrame, fan_bits: int) -> DataFrame:
    """Neighbours of one level put together, of conversations with more than one node there."""
    many = level.where("last > 0")
    child = F.struct("node", "costs", "audits", "illegal", "first_initial", "last_initial")
    up = many.groupBy("conv_id", "begin", F.shiftright("last", fan_bits).alias("last"), F.shiftright("node", fan_bits).alias("node"))
    children = up.agg(F.array_sort(F.collect_list(child)).alias("children"))
    of = lambda field: F.transform("children", lambda c: c[field])
    inner = F.aggregate(of("illegal"), F.lit(0).cast("long"), lambda a, x: a + x)
    seams = F.transform(
        "children",
        lambda c, i: F.when(
            (i > 0) & ~F.concat(F.get(F.col("children"), i - 1)["last_initial"], c["first_initial"]).isin("su", "ua", "au"), 1
        ).otherwise(0),
    )
    between = F.aggregate(seams, F.lit(0), lambda a, x: a + x)
    return children.select(
        "conv_id", "begin", "last", "node",
        F.transform("children", lambda c: F.struct(c["node"].alias("node"), c["costs"].alias("costs"), c["audits"].alias("audits"))).alias("steps"),
        (inner + between).alias("illegal"),
        F.col("children")[0]["first_initial"].alias("first_initial"),
        F.element_at(F.col("children"), -1)["last_initial"].alias("last_initial"),
    )


def _pair(route: Column, at: Column | int = 0) -> Column:
    """Index of the 16 pairs for two neighbouring states of a route."""
    at = F.lit(at) if isinstance(at, int) else at
    digit = lambda i: F.substr(route, i + 1, F.lit(1)).cast("int")
    return digit(at) * STATES + digit(at + 1)


def _edited_rows(found: DataFrame, levels: list, whole: DataFrame, totals: DataFrame, segment_bits: int, fan_bits: int) -> DataFrame:
    """Send the chosen states down the levels and join the edits to the rows."""
    chosen = None
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level].select("begin", "last", "node", "audits", "routes")
        roots = nodes.where("last = 0").join(whole.select("begin", _pair(F.col("route")).alias("pair")), "begin")
        if chosen is not None:
            below = chosen.select(
                "begin",
                F.col("node").alias("up"),
                F.col("route").alias("up_route"),
            )
            inner = nodes.where("last > 0").withColumn("up", F.shiftright("node", fan_bits)).join(below, ["begin", "up"])
            nth = (F.col("node") - F.shiftleft("up", fan_bits)).cast("int")
            inner = inner.withColumn("pair", _pair(F.col("up_route"), nth)).drop("up", "up_route")
            roots = roots.unionByName(inner)
        chosen = roots.select(
            "begin", "node", F.get("audits", F.col("pair")).alias("audit"), F.get("routes", F.col("pair")).alias("route")
        )
        if level:
            chosen = stage(chosen, f"chosen-{level}")
    edits = F.posexplode(F.regexp_extract_all("audit", F.lit("I*[DKR]"), F.lit(0))).alias("i", "edit")
    each = chosen.select("begin", "node", "route", edits).select(
        (F.col("begin") + F.shiftleft("node", segment_bits) + F.col("i")).alias("pos"),
        F.substr("route", F.col("i") + 1, F.lit(1)).cast("int").alias("state"),
        "edit",
    )
    kept = found.select("pos", "conv_id", "role", "text", "fault").join(each, "pos")
    open_ends = whole.join(totals.select("begin", "n"), "begin").where(F.substring("route", 2, 1).isin("1", "2"))
    state = F.substring("route", 2, 1).cast("int")
    tails = open_ends.select(
        (F.col("begin") + F.col("n")).alias("pos"),
        "conv_id",
        *[F.lit(None).cast("string").alias(c) for c in ("role", "text", "fault")],
        state.alias("state"),
        F.when(state == 1, "II").otherwise("I").alias("edit"),
    )
    return kept.unionByName(tails)


def repaired_turns(edited: DataFrame) -> DataFrame:
    """conv_id, pos, place, role, text of the repaired conversations, inserted turns included.

    A turn's place counts the turns that come of one row; pos and place give the order.
    """
    letter = F.regexp_extract("edit", "[DKR]$", 0)
    inserts = F.length(F.regexp_extract("edit", "^I*", 0))
    answers = lambda i: F.pmod((F.col("state") == 2).cast("int") + i, F.lit(2)) == 1
    name = lambda i: F.when(answers(i), "assistant").otherwise("user")
    line = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    added = F.transform(
        F.when(inserts > 0, F.sequence(F.lit(0), inserts - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: line(name(i), F.lit("")),
    )
    own = F.when(letter == "K", F.array(line(F.col("role"), F.col("text")))).when(
        letter == "R", F.array(line(name(inserts), F.col("text")))
    )
    turns = F.concat(added, F.coalesce(own, F.array().cast("array<struct<role:string,text:string>>")))
    return edited.select("conv_id", "pos", F.posexplode(turns).alias("place", "turn")).select("conv_id", "pos", "place", "turn.*")


def digest_turns(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of lines `role:text` joined by line ends.

    A digest is one sequence, so one task takes all lines of a conversation; it streams them.
    """
    lines = turns.select("conv_id", "pos", "place", F.concat_ws(":", "role", "text").alias("line"))
    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, done = None, None, []
        names = ["conv_id", "repaired_sha256"]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=names)

        for batch in batches:
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("line")):
                if digest is None or conv != held:
                    if digest is not None:
                        done.append((held, digest.hexdigest()))
                    held, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(text.as_buffer())
            yield out()
            done = []
        if digest is not None:
            done.append((held, digest.hexdigest()))
        yield out()

    return dealt.select("conv_id", "line").mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def repair_conversations(conversations: DataFrame, rows: DataFrame, **sizes) -> DataFrame:
    """One row for every conv_id of conversations, of which rows is what is to be repaired."""
    summary, edited = plan_repairs(rows.select("conv_id", "turn", "role", "text"), **sizes)
    digests = digest_turns(repaired_turns(edited))
    every = conversations.select("conv_id").distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    joined = every.join(summary, same_conversation(every, summary), "left").drop(summary["conv_id"])
    full = joined.join(digests, same_conversation(joined, digests), "left").drop(digests["conv_id"])
    empty = hashlib.sha256().hexdigest()
    return full.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
