"""Jaccard join of shingle sets over a token-group matrix.

Sets are put into groups of similar ones, and a group keeps the union of its members' tokens: the token-group matrix.  What a set shares
with a group's union bounds what it can share with any member, so only groups that reach the threshold are opened and
their members compared.

Which groups come into question at all is found over parts of sets.  Sets that link differ in few tokens; dealt into more parts than
that by hash, they have a part in common as a whole, and by chance next to no others do.  Links inside a component need no more looking
at: large families of near copies are first tied together, each set to one other (linear work), and only parts that still
occur in different components are looked up afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import components, cut_lineage, salted_join, written

SHINGLE = 3
#: Sets link if their intersection holds at least this many hundredths of their union.
PERCENT = 90
#: Members of a group.
GROUP = 256
#: Tokens are counted by the top bits of their hashes; one whose counter holds ``COMMON`` times the mean or more is common.
COUNTER_BITS = 16
COMMON = 4
#: Parts beyond those in which sets that link can differ.
SPARE = 4
#: Lookups of one part, and queries of one group, that go to the same task.
SHARE = 2048
_U64 = np.uint64


# -- sets -----------------------------------------------------------------------------------------

def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes: words are runs of anything but ASCII white space, A-Z lower-cased.

    Fewer words than a shingle are one shingle; no word, no shingle.
    """
    words = (text or "").encode().lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, _U64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), _U64, len(words))
    size = min(size, len(words))
    made = np.full(len(words) - size + 1, size, _U64)
    for i in range(size):
        made = _mixed(made * _U64(0x9E3779B97F4A7C15) + hashes[i : i + len(made)])
    made.sort()
    return made[np.concatenate([[True], made[1:] != made[:-1]])]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


def _common(texts: DataFrame, shingle: int) -> np.ndarray:
    """Which counters stand for common tokens; all tokens of all texts are counted.  It only says which parts are worth looking up."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, size = np.zeros(1 << COUNTER_BITS, np.int64), [], 0
        for batch in batches:
            for text in batch["text"]:
                held.append((shingles(text, shingle) >> _U64(64 - COUNTER_BITS)).astype(np.int32))
                if (size := size + len(held[-1])) > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"counter": at, "n": total[at]})

    counted = texts.select("text").mapInPandas(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    rows = counted.collect()  # one for each counter
    total = np.zeros(1 << COUNTER_BITS)
    total[[r["counter"] for r in rows]] = [r["n"] for r in rows]
    return total >= COMMON * max(total.mean(), 1.0)


def _bands(percent: int, most: int) -> list[int]:
    """The largest size in each band: sets that link lie in the same or in neighbouring bands."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, 100 * (ends[-1] + 1) // percent))
    return ends


def _differing(sizes: int | Column, percent: int) -> int | Column:
    """In how many tokens two sets that link differ at most, by the sum of their sizes."""
    if isinstance(sizes, Column):
        return F.floor(sizes * (100 - percent) / (100 + percent) + 1e-9).cast("int")
    return sizes * (100 - percent) // (100 + percent)


def _dealt(differing: int | Column) -> int | Column:
    """Parts that sets are dealt into: some more than can differ, so that sets that link have several in common."""
    if isinstance(differing, Column):
        return differing + 1 + F.least(F.floor(differing / 2), F.lit(SPARE)).cast("int")
    return differing + 1 + min(differing // 2, SPARE)


def parts_of(tokens: np.ndarray, percent: int, common: np.ndarray | None = None) -> list[dict]:
    """``size, hidden, parts`` for the sets of its own band and the one below, and for those of the band above.

    Sets of at most ``size`` tokens are dealt into the same number of parts by the hashes of their tokens; ``parts`` are 32-bit hashes of a set's (sorted
    hashes).  Parts without tokens, or with none that is not ``common``, are shared by many sets; the ``hidden`` ones of these are
    not shown, unless there are so many that all that two sets have in common may be among them; then the number is negative.
    """
    ends = _bands(percent, len(tokens))
    above = max(ends[-1] + 1, 100 * (ends[-1] + 1) // percent)
    mixed, found = _mixed(tokens ^ _U64(0x5851F42D4C957F2D)), []
    own = np.ones(len(tokens), np.int64) if common is None else (~common[(tokens >> _U64(64 - COUNTER_BITS)).astype(np.int64)]).astype(np.int64)
    for size in (ends[-1], above):
        differing = _differing(2 * size, percent)
        parts = _dealt(differing)
        of = tokens % _U64(parts)
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))
        sums, telling = np.zeros(parts, _U64), np.zeros(parts, np.int64)
        filled = of[order][starts].astype(np.int64)
        sums[filled] = np.add.reduceat(mixed[order], starts)
        telling[filled] = np.add.reduceat(own[order], starts)
        shown = np.flatnonzero(telling)
        hidden = parts - len(shown)
        if hidden >= parts - differing:
            shown, hidden = np.arange(parts), -hidden
        hashes = _mixed(sums[shown] + shown.astype(_U64) * _U64(0x9E3779B97F4A7C15) + _U64(size)) >> _U64(32)
        found.append({"size": size, "hidden": hidden, "parts": hashes.astype(np.uint32).view(np.int32)})
    return found


def _sets(texts: DataFrame, shingle: int, percent: int, common: np.ndarray) -> DataFrame:
    """``doc_id, text_key, n, digest, dealt``: the size of each row's set, what tells sets apart, and its parts."""

    @F.pandas_udf("struct<n:int,digest:binary,dealt:array<struct<size:int,hidden:int,parts:array<int>>>>")
    def of(column: pd.Series) -> pd.DataFrame:
        found = []
        for text in column:
            tokens = shingles(text, shingle)
            found.append((len(tokens), xxhash.xxh3_128_digest(tokens.tobytes()), parts_of(tokens, percent, common) if len(tokens) else []))
        return pd.DataFrame(found, columns=["n", "digest", "dealt"])

    made = texts.select("doc_id", F.xxhash64("text").alias("text_key"), of("text").alias("s"))
    return made.select("doc_id", "text_key", "s.n", "s.digest", "s.dealt")


def _whole_sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``id, tokens`` of the sets in ``wanted`` (``id, of_doc, of_key``: a row that has the set)."""

    @F.pandas_udf("array<bigint>")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, shingle).view(np.int64) for t in column])

    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.xxhash64("text") == F.col("of_key"))
    return texts.join(wanted, same).dropDuplicates(["id"]).select("id", of("text").alias("tokens"))


# -- groups ---------------------------------------------------------------------------------------

class _Group:
    """The token-group matrix of one group: its token union and, for each token, the members that have it."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]) -> None:
        self.ids, self.comps = [r[0] for r in rows], np.array([r[1] for r in rows])
        self.sizes = np.array([len(r[2]) for r in rows])
        tokens = np.concatenate([r[2] for r in rows])
        order = np.argsort(tokens, kind="stable")
        self.members = np.repeat(np.arange(len(rows)), self.sizes)[order]
        self.union, self.starts = np.unique(tokens[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(tokens))

    def links(self, one: int, comp: int, tokens: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """The set's links, one for each other component.  Only if it shares enough with the union the group is opened."""
        at = np.searchsorted(self.union, tokens)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == tokens]
        if 100 * len(at) < percent * len(tokens):
            return []  # no member can link
        starts, sizes = self.starts[at], self.ends[at] - self.starts[at]
        ends = np.cumsum(sizes)
        having = self.members[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)]
        both = np.bincount(having, minlength=len(self.ids))
        near = np.flatnonzero((100 * both >= percent * (len(tokens) + self.sizes - both)) & (self.comps != comp))
        _, first = np.unique(self.comps[near], return_index=True)
        return [(one, self.ids[i]) for i in near[first]]


def _open(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Links of the queries of each group, whose members come first."""
    number, held, group = None, [], None
    for batch in batches:
        found: list[tuple[int, int]] = []
        for name, part, is_query, one, comp, tokens in zip(*(batch[c] for c in ("of_group", "part", "is_query", "id", "comp", "tokens"))):
            if (name, part) != number:
                number, held, group = (name, part), [], None
            tokens = np.asarray(tokens, np.int64).view(_U64)
            if not is_query:
                held.append((one, comp, tokens))
                continue
            group = group or _Group(held)
            found += group.links(one, comp, tokens, percent)
        yield pd.DataFrame(found, columns=["a", "b"])


def _links(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` of the queries in ``pairs`` (``id, of_group, comp``, distinct) with members of their group (``members``: ``of_group, id, comp``)."""
    parts = pairs.groupBy("of_group").agg((F.floor((F.count("*") - 1) / SHARE) + 1).cast("long").alias("parts"))
    asked = pairs.join(parts, "of_group").select("of_group", F.pmod("id", "parts").alias("part"), F.lit(True).alias("is_query"), "id", "comp")
    held = members.join(parts, "of_group").select(
        "of_group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_query"), "id", "comp"
    )
    rows = held.unionByName(asked).join(sets, "id")
    rows = rows.repartition("of_group", "part").sortWithinPartitions("of_group", "part", "is_query")
    return rows.mapInPandas(lambda batches: _open(batches, percent), "a long, b long")


def _may_link(shared: Column, n: Column, hidden: Column, least: Column, most: Column, g_hidden: Column, g_all: Column, size: Column, percent: int) -> Column:
    """Whether a set and one of a group (sizes ``least`` to ``most``, ``g_hidden`` parts hidden at most or, with ``g_all``, all shown) may link that have
    ``shared`` parts in common of those for ``size``.

    Each other part is hidden in both, or they differ in a token of it.
    """
    fits = (most * 100 >= n * percent) & (n * 100 >= least * percent)
    parts = _dealt(_differing(2 * size, percent))
    unseen = F.when((hidden < 0) & g_all, 0).otherwise(F.least(F.abs(hidden), g_hidden))
    return fits & (shared + unseen >= parts - _differing(n + F.least(most, n * (100 / percent)), percent))


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (sets at their parts) with the families at the same part that have sets of other components and of a fitting size.

    A family is one row at a part, however many groups it has, and is asked by its own sets and by those of smaller families (equal sizes: of lower
    leaders), so a part that a whole family has costs next to nothing but a row for each of its sets.
    """
    families = rows.groupBy("part", "sets", "leader").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("tasks").alias("f_tasks"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.max(F.abs("hidden")).alias("g_hidden"), F.max("hidden").alias("g_most"),
    )
    held = families.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("f_tasks") - 1))).drop("f_tasks")
    own = (F.col("sets").alias("own_sets"), F.col("leader").alias("own"))
    asks = rows.select("part", F.pmod("id", "tasks").cast("int").alias("task"), "id", "size", "hidden", "n", "comp", *own)
    turn = (F.col("sets") > F.col("own_sets")) | ((F.col("sets") == F.col("own_sets")) & (F.col("leader") >= F.col("own")))
    return asks.join(held, ["part", "task"]).where(_fits(percent) & _others() & turn)


def _fits(percent: int) -> Column:
    return (F.col("most") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("least") * percent)


def _others() -> Column:
    return (F.col("lo") != F.col("comp")) | (F.col("hi") != F.col("comp"))


def _candidates(live: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """``id, of_group, comp``: the groups with sets of other components that have parts in common and a fitting size; of two sets that may link, one asks
    for the group of the other.

    Only parts that occur in different components are looked up.
    """
    rows = live.select("part", "id", "size", "hidden").join(placed.drop("number"), "id")
    apart = rows.groupBy("part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("asks")).where("lo != hi")
    rows = written(rows.join(apart.select("part", (F.floor((F.col("asks") - 1) / SHARE) + 1).cast("int").alias("tasks")), "part"), "matrix")
    # What a family has at a part is that of its sets there, so its sizes are taken over all parts that were met.
    shared = _met(rows, percent).groupBy("id", "leader", "size").agg(
        F.count("*").alias("n_shared"), F.first("n").alias("n"), F.first("comp").alias("comp"), F.first("hidden").alias("hidden"), F.min("least").alias("least"),
        F.max("most").alias("most"), F.max("g_hidden").alias("g_hidden"), (F.max("g_most") < 0).alias("g_all"), F.first("sets").alias("sets"),
    )
    may = _may_link(*[F.col(c) for c in ("n_shared", "n", "hidden", "least", "most", "g_hidden", "g_all", "size")], percent)
    near = shared.where(may).groupBy("id", "leader").agg(F.first("sets").alias("sets"))
    asked = near.select("id", "leader", F.explode(F.sequence(F.lit(0).cast("long"), _groups("sets") - 1)).alias("number"))
    asked = asked.join(placed.select("id", "n", "comp", F.col("leader").alias("own"), F.col("number").alias("own_number")), "id")
    groups = placed.groupBy("leader", "number").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    # Two groups of one family: the numbers say which of them asks, each about as often as it is asked.
    odd = (F.col("own_number") + F.col("number")) % 2 == 1
    turn = (F.col("own") != F.col("leader")) | (F.col("own_number") == F.col("number")) | (odd == (F.col("own_number") < F.col("number")))
    return asked.where(turn).join(groups, ["leader", "number"]).where(_fits(percent) & _others()).select("id", _of_group(), "comp")


def _groups(sets: str) -> Column:
    """How many groups a family is dealt into."""
    return F.ceil(F.col(sets) / GROUP).cast("long")


def _of_group() -> Column:
    return F.concat_ws(":", F.col("leader").cast("string"), F.col("number").cast("string")).alias("of_group")


def _placed(sizes: DataFrame, roots: DataFrame, leaders: DataFrame) -> DataFrame:
    """``id, n, comp, leader, sets, number``: each set's component, its family and the size of that, and the number of its group.

    A family is the sets that are most like the same one (``leaders``: ``id, leader``), whether they link with it or not; its groups hold about ``GROUP``.
    """
    of = sizes.join(roots.withColumnsRenamed({"node": "id"}), "id", "left").join(leaders, "id", "left")
    of = of.select("id", "n", F.coalesce("root", "id").alias("comp"), F.coalesce("leader", "id").alias("leader"))
    large = of.groupBy("leader").agg(F.count("*").alias("sets")).where("sets > 1")
    led = of.join(large, "leader", "left").withColumn("sets", F.coalesce("sets", F.lit(1).cast("long")))
    return cut_lineage(led.select("id", "n", "comp", "leader", "sets", F.pmod(F.xxhash64("id"), _groups("sets")).alias("number")))


# -- documents ------------------------------------------------------------------------------------

def link_components(sizes: DataFrame, parts: DataFrame, sets_of, percent: int = PERCENT) -> DataFrame:
    """``node, root`` of the sets (``sizes``: ``id, n``) whose component has a smaller id, from their parts (``parts``: ``id, size, hidden, part``).

    ``sets_of(ids)`` gives the whole sets, ``id, tokens``; it is asked for those that are compared at all.
    """
    shared = parts.groupBy("part").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("sets")).where("lo != hi")
    live = written(parts.join(shared.select("part", "sets"), "part"), "live")
    # First every set against one other: of the sets at most of its parts the most central one, whose parts are the most shared.  Of copies of one
    # text that is the text itself, or the one least changed.
    central = live.groupBy("id").agg(F.sum("sets").alias("shares")).join(sizes, "id").select("id", (F.col("shares") / F.col("n")).alias("share"))
    middle = live.select("id", "part").join(central, "id").groupBy("part").agg(F.max_by("id", F.struct("share", -F.col("id"))).alias("low"))
    of_low = sizes.select(F.col("id").alias("low"), F.col("n").alias("low_n"))
    near = salted_join(live.drop("sets"), middle, "part", "id").where("id != low")
    met = cut_lineage(near.groupBy("id", "low", "size").agg(F.count("*").alias("n_shared"), F.first("hidden").alias("hidden")))
    may = _may_link(F.col("n_shared"), F.col("n"), F.col("hidden"), F.col("low_n"), F.col("low_n"), F.abs("hidden"), F.lit(True), F.col("size"), percent)
    fitting = met.join(sizes, "id").join(of_low, "low").where(may)
    most_alike = F.max_by("low", F.struct("n_shared", -F.col("low")))
    partner = cut_lineage(fitting.groupBy("id").agg(most_alike.alias("of_group")))
    leaders = partner.select(F.col("of_group").alias("id")).distinct()
    sets = cut_lineage(sets_of(partner.select("id").unionByName(leaders).distinct()))
    own = F.col("id").alias("comp")
    found = _links(partner.select("id", "of_group", own), leaders.select(F.col("id").alias("of_group"), "id", own), sets, percent)
    roots = cut_lineage(components(found))
    # Then all groups that are left.
    placed = _placed(sizes.join(live.select("id").distinct(), "id", "left_semi"), roots, met.groupBy("id").agg(most_alike.alias("leader")))
    near = cut_lineage(_candidates(live, placed, percent))
    if near.isEmpty():
        return roots
    members = placed.select(_of_group(), "id", "comp").join(near.select("of_group").distinct(), "of_group", "left_semi")
    sets = cut_lineage(sets_of(near.select("id").unionByName(members.select("id")).distinct()))
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(cut_lineage(links.unionByName(_links(near, members, sets, percent))))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Two rows link if their sets of shingles share ``percent`` hundredths of their union or more; ``component_id`` is the smallest id that
    can be reached over links, null if none of the component has one.  A text without words (null, empty) has an empty set and
    links with nothing.  Repeated rows link like any equal texts; an empty table gives no rows; other columns are not read.
    Shingles are told apart by 64-bit hashes.  ``percent`` is at least 50.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    of_rows = written(_sets(texts, shingle, percent, _common(texts, shingle)), "sets")
    filled = of_rows.where("n > 0")
    distinct = cut_lineage(
        filled.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.first("dealt").alias("dealt"))
    ).withColumn("id", F.monotonically_increasing_id())

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = distinct.join(ids, "id", "left_semi").select("id", F.col("one.doc_id").alias("of_doc"), F.col("one.text_key").alias("of_key"))
        return _whole_sets(texts, wanted, shingle)

    parts = distinct.select("id", F.explode("dealt").alias("d")).select("id", "d.size", "d.hidden", F.explode("d.parts").alias("part"))
    roots = link_components(distinct.select("id", "n"), parts, sets_of, percent)
    rooted = distinct.join(roots.withColumnsRenamed({"node": "id"}), "id", "left").select("digest", "first_id", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut_lineage(rooted.join(least, "root").select("digest", "component_id"))
    linked = filled.join(named, "digest").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = of_rows.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
