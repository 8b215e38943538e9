"""Secret scan in DataFrame functions: known shapes, and a battery of randomness tests over long tokens.

A token's encoding is inferred from its characters.  Three tests ask whether it is a random string of that encoding: chi-squared over
the alphabet, runs above and below its middle, serial correlation.  Their combined p-value is held against that of strings which are
none: characters of the texts in the same alphabet and of the same length.  For each encoding and length band the cut is the lowest at
which these account for no more than ``FALSE_SHARE`` of the findings.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.arrays import largest_before, let, offsets
from scriptorium.llm.common import cut_lineage

#: Kinds in the order of the contract: pattern (matched leftmost, without overlap) and, behind it, the least length of the
#: given group.  A failing match is dropped but uses up its characters.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": (ASSIGN, 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]{24,}", 0, 24)}
KINDS = [*BASE, "random"]
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: Least token lengths of the bands.
BANDS = (20, 28, 40, 64, 128)
FALSE_SHARE = 0.05
BINS = 200
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, the first that fits is inferred.
ENCODINGS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "mixed": _UPPER + _LOWER + _DIGITS + "+/-_",
}
#: How unevenly text spreads over the letters of an encoding (chance that two of its characters are equal): letters of European languages,
#: written numbers, hexadecimal words.  It stands for ``PRIOR`` strings beside those of the texts, so few texts suffice.
UNEVEN = {"decimal": 0.15, "hex": 0.12, "HEX": 0.12, "lower": 0.0667, "base32": 0.0667}
UNEVEN_OTHER = 0.06
PRIOR = 20


# -- places ---------------------------------------------------------------------------------------

def untouched(tokens: Column, spans: Column) -> Column:
    """The ``tokens`` that overlap none of ``spans``: one sweep over both by start.

    A span that begins before a token overlaps it if it, or any before it, ends behind its start; one that begins inside it is the next in order.
    """
    item = lambda x, token, found: F.struct(x["start"].alias("start"), F.lit(token).alias("token"), x["end"].alias("end"), found.alias("found"))
    both = F.concat(F.transform(spans, lambda b: item(b, 0, F.lit(None).cast("string"))), F.transform(tokens, lambda t: item(t, 1, t["found"])))

    def swept(order: Column) -> Column:
        ends = F.transform(order, lambda x: F.when(x["token"] == 0, x["end"]).otherwise(F.lit(-1).cast("long")))
        seen = F.arrays_zip(order.alias("x"), largest_before(ends).alias("ended"))
        clear = F.filter(seen, lambda z, i: (z["x"]["token"] == 1) & (z["ended"] <= z["x"]["start"])
                         & ~F.coalesce((F.get(order, i + 1)["token"] == 0) & (F.get(order, i + 1)["start"] < z["x"]["end"]), F.lit(False)))
        return F.transform(clear, lambda z: F.struct(z["x"]["start"].alias("start"), z["x"]["end"].alias("end"), z["x"]["found"].alias("found")))

    return F.when(F.size(spans) == 0, tokens).otherwise(let(F.array_sort(both), swept))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``start, end, found`` of every match; ``found`` is the group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    size = lambda x: F.size(x["whole"])
    spans = lambda x: F.arrays_zip(
        F.slice(x["gaps"], 1, size(x)).alias("gap"), F.transform(x["whole"], lambda m: F.length(m).cast("long")).alias("n"), x["found"].alias("found")
    )
    placed = lambda s: F.arrays_zip(s.alias("s"), offsets(F.transform(s, lambda v: v["gap"] + v["n"])).alias("at"))
    row = lambda z: F.struct(
        (z["at"] + z["s"]["gap"]).alias("start"), (z["at"] + z["s"]["gap"] + z["s"]["n"]).alias("end"), z["s"]["found"].alias("found")
    )
    parts = F.struct(whole.alias("whole"), gaps.alias("gaps"), found.alias("found"))
    rows = F.transform(let(let(parts, spans), placed), row)
    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


# -- the battery ----------------------------------------------------------------------------------

def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic fit that is off by 2e-4 at most."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(0.07056 * z * z * z + 1.5976 * z))


def encoding(token: Column) -> Column:
    """Place in ``ENCODINGS`` of the first one that has all characters of the token; padding is left out."""
    body = F.rtrim(token, F.lit("="))
    chosen = F.lit(len(ENCODINGS) - 1)
    for place, letters in reversed(list(enumerate(ENCODINGS.values()))[:-1]):
        escaped = letters.replace("-", r"\-")
        chosen = F.when(body.rlike(f"^[{escaped}]+$"), place).otherwise(chosen)
    return chosen


def randomness(token: Column, place: Column | None = None) -> Column:
    """Combined p-value (Fisher) of the three tests; about uniform for random strings, near zero for words.  Padding is left out.

    ``place``: of the encoding in ``ENCODINGS``; it is inferred if not given.
    """
    body = F.rtrim(token, F.lit("="))
    letters = F.element_at(F.array(*[F.lit(x) for x in ENCODINGS.values()]), (encoding(token) if place is None else place) + 1)
    measured = let(F.struct(body.alias("t"), letters.alias("letters")), _measured)
    return let(let(let(measured, _centred), _statistics), lambda z: let(_half_deviance(z), lambda h: F.exp(-h) * (1 + h + h * h / 2)))


def _measured(x: Column) -> Column:
    """Places of the characters in the alphabet, sizes, and the chi-squared statistic in standard units."""
    t, letters = x["t"], x["letters"]
    k, n = F.length(letters).cast("double"), F.length(t).cast("double")
    counts = F.transform(F.split(letters, ""), lambda c: n - F.length(F.replace(t, c, F.lit(""))))
    squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
    z_chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
    places = F.transform(F.split(t, ""), lambda c: F.instr(letters, c).cast("double"))
    return F.struct(places.alias("p"), n.alias("n"), k.alias("k"), z_chi.alias("z_chi"), (F.aggregate(places, F.lit(0.0), lambda a, v: a + v) / n).alias("mean"))


def _centred(x: Column) -> Column:
    mean, k = x["mean"], x["k"]
    return F.struct(
        x["n"].alias("n"), x["z_chi"].alias("z_chi"),
        F.transform(x["p"], lambda v: (v > k / 2).cast("double")).alias("high"), F.transform(x["p"], lambda v: v - mean).alias("off"),
    )


def _statistics(x: Column) -> Column:
    """Standard units of the three tests: one-sided, then two two-sided ones."""
    n, high, off = x["n"], x["high"], x["off"]
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    beside = lambda v, f: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), f)
    runs = 1 + total(beside(high, lambda a, b: F.abs(a - b)))

    def z_runs(both: Column) -> Column:
        spread = F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
        return F.abs((runs - both / n - 1) / spread)

    lag = total(beside(off, lambda a, b: a * b)) / F.greatest(total(F.transform(off, lambda v: v * v)), F.lit(1e-9))
    return F.array(x["z_chi"], let(total(high), lambda n1: let(2 * n1 * (n - n1), z_runs)), F.abs((lag + 1 / n) * F.sqrt(n)))


def _half_deviance(z: Column) -> Column:
    p = F.transform(z, lambda v, i: F.least(_tail(v) * F.when(i == 0, 1).otherwise(2), F.lit(1.0)))
    return F.aggregate(p, F.lit(0.0), lambda a, v: a - F.log(F.greatest(v, F.lit(1e-15))))


def _band(n: Column) -> Column:
    return reduce(lambda done, least: F.when(n >= least, least).otherwise(done), BANDS[1:], F.lit(BANDS[0]))


# -- documents ------------------------------------------------------------------------------------

def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, found``.

    ``spans``: ``kind:start:end`` of all findings by start, then kind, in code points, end exclusive; ``base_sha256`` is the digest of
    those of known shapes.  The battery judges every token of 20 and more characters that touches no base span, whatever it is made of;
    in short bands of few letters no cut may separate keys from words, and nothing is found there.  ``found``: the findings as structs.  Null and empty texts have no findings; repeated rows have equal results; an
    empty table gives no rows; other columns are not read.
    """
    t = F.col("t")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    named = []
    for order, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        named.append(_kept(_matches(t, pattern, group), least, order, kind))
    wide = rows.select("doc_id", F.array_sort(F.concat(*named)).alias("base"), _matches(t, TOKEN).alias("tokens"), _plain(t).alias("plain"))
    judged = F.transform(
        untouched(F.col("tokens"), F.col("base")),
        lambda m: let(encoding(m["found"]), lambda e: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.xxhash64(m["found"]).alias("token"),
            _cell(e, _band(F.length(F.rtrim(m["found"], F.lit("="))))).alias("cell"), randomness(m["found"], e).alias("p"),
        )),
    )
    decoys = F.transform("plain", lambda d: F.struct(F.xxhash64(d["text"]).alias("token"), _cell(d["encoding"], F.length(d["text"])).alias("cell"), randomness(d["text"], d["encoding"]).alias("p")))
    base = cut_lineage(wide.select("doc_id", "base", judged.alias("judged"), decoys.alias("decoys")))
    cuts = cut_at(base.select(F.explode("judged").alias("x")).select("x.*"), base.select(F.explode("decoys").alias("x")).select("x.*"), false_share)
    allowed = F.create_map(*[F.lit(v) for pair in cuts.items() for v in pair]) if cuts else F.create_map().cast("map<int,double>")
    random = F.filter("judged", lambda j: j["p"] >= F.coalesce(F.try_element_at(allowed, j["cell"]), F.lit(2.0)))
    random = F.transform(random, lambda m: _finding(m, len(BASE), "random"))
    every = F.array_sort(F.concat("base", random))
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")
    return base.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_told(F.col("base")), 256).alias("base_sha256"),
        _told(every).alias("spans"),
        F.size(random).cast("long").alias("n_random"),
        every.alias("found"),
    )


def _kept(matches: Column, least: int, order: int, kind: str) -> Column:
    return F.transform(F.filter(matches, lambda m: F.length(m["found"]) >= least), lambda m: _finding(m, order, kind))


def _finding(m: Column, order: int, kind: str) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind"))


def _told(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def _cell(place: Column, band: Column) -> Column:
    """Encoding and length band in one number."""
    return (place * 1000 + band).cast("int")


def _plain(text: Column) -> Column:
    """``text, encoding``: characters of the text that are in an encoding's alphabet, a piece of each band's least length at a place chosen by hash.

    Each band gets the next one of the encodings, from where the text's hash points, so all texts together serve every encoding.
    """
    letters = F.regexp_replace(text, "[^A-Za-z0-9]+", "")
    none = ""
    ways = {"decimal": ("[^0-9]+", none), "hex": ("[^0-9a-f]+", "lower"), "HEX": ("[^0-9A-F]+", "upper"), "lower": ("[^a-z]+", "lower"), "base32": ("[^A-Z2-7]+", "upper"),
            "base36": (none, "lower"), "BASE36": (none, "upper")}

    def kept(of: Column, name: str) -> Column:
        pattern, case = ways.get(name, (none, none))
        cased = F.lower(of) if case == "lower" else F.upper(of) if case == "upper" else of
        return F.regexp_replace(cased, pattern, "") if pattern else cased

    def piece(of: Column, place: int, n: int) -> Column:
        cut = lambda s: F.struct(F.substring(s, F.pmod(F.xxhash64(s), F.greatest(F.length(s) - n + 1, F.lit(1))).cast("int") + 1, n).alias("text"), F.lit(place).alias("encoding"))
        return let(kept(of, list(ENCODINGS)[place]), cut)

    def pieces(of: Column) -> Column:
        turn = F.pmod(F.xxhash64(of), F.lit(len(ENCODINGS))).cast("int")

        def at(t: Column) -> Column:
            dealt = []
            for k, n in enumerate(BANDS):
                chosen = piece(of, (len(ENCODINGS) - 1 + k) % len(ENCODINGS), n)
                for first in range(len(ENCODINGS) - 1):
                    chosen = F.when(t == first, piece(of, (first + k) % len(ENCODINGS), n)).otherwise(chosen)
                dealt.append(chosen)
            return F.filter(F.array(*dealt), lambda d: F.array_contains(F.lit(list(BANDS)), F.length(d["text"])))

        return let(turn, at)

    return let(letters, pieces)


def _upper_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def text_passes(place: int, n: int, cut: float) -> float:
    """An upper bound for the chance that ``n`` characters of text, spread as ``UNEVEN`` says, reach the combined p-value ``cut``.

    That needs a chi-squared test of at least exp(-h), where h is the half deviance at the cut; the statistic of text is about normal.
    """
    name = list(ENCODINGS)[place]
    k = len(ENCODINGS[name])
    low, high = 0.0, 60.0
    for _ in range(60):  # exp(-h) * (1 + h + h * h / 2) = cut
        h = (low + high) / 2
        low, high = (h, high) if math.exp(-h) * (1 + h + h * h / 2) > cut else (low, h)
    z_low, z_high = -9.0, 9.0
    for _ in range(60):  # the largest z whose tail is exp(-h)
        z = (z_low + z_high) / 2
        z_low, z_high = (z, z_high) if _upper_tail(z) > math.exp(-low) else (z_low, z)
    beyond = n * max(0.0, k * UNEVEN.get(name, UNEVEN_OTHER) - 1)
    mean, spread = beyond / math.sqrt(2 * (k - 1)), math.sqrt(1 + 2 * beyond / (k - 1))
    return _upper_tail((mean - z_low) / spread)


def cut_at(targets: DataFrame, decoys: DataFrame, false_share: float) -> dict[int, float]:
    """For each cell the lowest p at which decoys make up ``false_share`` of the findings at most; copies count once.

    Expected false findings: the share of decoys beyond the cut times the cell's tokens.  ``PRIOR`` more decoys pass as often as ``text_passes``
    says; so a cell without any goes by that bound, and the more there are, the less it counts.
    """
    both = targets.select("cell", "token", "p", F.lit(1).alias("real")).unionByName(decoys.select("cell", "token", "p", F.lit(0).alias("real")))
    once = both.groupBy("cell", "real", "token").agg(F.min("p").alias("p"))
    bins = once.groupBy("cell", F.floor(F.col("p") * BINS).cast("int").alias("bin")).agg(
        F.sum("real").alias("real"), F.sum(F.lit(1) - F.col("real")).alias("decoy")
    )
    found: dict[int, float] = {}
    rows = bins.orderBy("cell", F.desc("bin")).collect()  # a row per cell and bin at most
    for cell in {r.cell for r in rows}:
        own = [r for r in rows if r.cell == cell]
        tokens, strings = sum(r.real for r in own), sum(r.decoy for r in own)
        real = decoy = 0
        for r in own:
            real, decoy = real + r.real, decoy + r.decoy
            share = (decoy + PRIOR * text_passes(cell // 1000, cell % 1000, r.bin / BINS)) / (strings + PRIOR)
            if real and tokens * share <= false_share * real:
                found[cell] = r.bin / BINS
    return found
