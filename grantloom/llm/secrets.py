"""Secret scans by patterns and a randomness battery, in Spark SQL expressions only.

Base spans come from three patterns (assignments, access keys, hexadecimal runs). The method adds long runs of key
characters that look random. For each run the encoding (the least alphabet that holds it) is inferred and a battery asks
whether it can be uniform random over it: chi-squared of the symbol counts, runs about the middle symbol, serial
correlation of neighbours. Runs that pass are then tested against ordinary words: too few equal symbols, too many
changes between lower case, upper case and digits. These p-values go through a Benjamini-Hochberg step per length band
over all runs of the corpus, so that the expected share of ordinary words among the added spans stays below ``FALSE_SHARE``.

Positions are code points, ends exclusive. Defined cases: null and empty texts have no spans; without runs nothing is
added; repeated rows count as often as they come; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.llm.common import stored, table

# The base patterns, in the order of the kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the whole run from the first prefix; a run that is too short has no longer one inside
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED = 6

#: Runs of key characters that the battery looks at.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets from narrow to wide: pattern that holds the run, symbols in order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (
    ("^[0-9]+$", DIGITS),
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("", UPPER + LOWER + DIGITS + "+/-_"),
)
#: A run is not random if one of its three tests lies further off than this many standard deviations.
BATTERY_Z = 3.3
#: Ordinary words: share of equal pairs of symbols, its third moment, and changes of character class per neighbour.
WORD_PAIRS, WORD_THIRD, WORD_CHANGES = 0.066, 0.0055, 0.15
#: Least lengths of the bands, expected share of ordinary words among the added spans, and steps per decade of p.
BANDS, FALSE_SHARE, STEPS = (20, 32, 48, 64), 0.01, 10


def _text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str, kind: int) -> str:
    """SQL for the matches of a pattern as structs (start, kind, stop, found), from the pieces between the matches."""
    p = _text_literal(pattern)
    return f"""aggregate(
        zip_with(slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))), regexp_extract_all({text}, {p}, 0),
            (gap, found) -> named_struct('gap', length(gap), 'found', found)),
        named_struct('at', 0, 'all', cast(array() as array<struct<start: int, kind: int, stop: int, found: string>>)),
        (a, x) -> named_struct('at', a.at + x.gap + length(x.found), 'all', concat(a.all,
            array(named_struct('start', a.at + x.gap, 'kind', {kind}, 'stop', a.at + x.gap + length(x.found), 'found', x.found)))),
        a -> a.all)"""


NO_SPANS = "cast(array() as array<struct<start: int, kind: int, stop: int, found: string>>)"


def _found(text: str, pattern: str, kind: int) -> str:
    """The matches, without work for texts that have none."""
    return f"if({text} rlike {_text_literal(pattern)}, {_spans(text, pattern, kind)}, {NO_SPANS})"


def base_spans(text: str) -> Column:
    """All base spans of a text column, by start, then kind."""
    value = _text_literal(ASSIGN.replace("^", ""))
    assigned = f"filter({_found(text, ASSIGN, 0)}, x -> length(regexp_extract(x.found, {value}, 2)) >= {LEAST_ASSIGNED})"
    return F.expr(f"array_sort(concat({assigned}, {_found(text, ACCESS, 1)}, {_found(text, HEX, 2)}))")


def _alphabet(run: str) -> str:
    cases = " ".join(f"when {run} rlike {_text_literal(p)} then {_text_literal(a)}" for p, a in ALPHABETS if p)
    return f"case {cases} else {_text_literal(ALPHABETS[-1][1])} end"


def _battery(run: str) -> str:
    """SQL for the sums that all tests need, in one pass over the symbols of a run (padding left out)."""
    symbols = f"filter(split(rtrim('=', {run}), ''), c -> c <> '')"
    return f"""aggregate(
        transform({symbols}, c -> named_struct('v', cast(locate(c, alphabet) - 1 as double),
            'kind', case when c between 'a' and 'z' then 1 when c between 'A' and 'Z' then 2 when c between '0' and '9' then 3 else 4 end)),
        named_struct('n', 0D, 'v', -1D, 'kind', 0, 'high', 0D, 'runs', 0D, 'sum', 0D, 'squares', 0D, 'cross', 0D, 'changes', 0D),
        (a, x) -> named_struct('n', a.n + 1D, 'v', x.v, 'kind', x.kind,
            'high', a.high + if(x.v >= length(alphabet) / 2, 1D, 0D),
            'runs', a.runs + if(a.n = 0D or (x.v >= length(alphabet) / 2) <> (a.v >= length(alphabet) / 2), 1D, 0D),
            'sum', a.sum + x.v, 'squares', a.squares + x.v * x.v,
            'cross', a.cross + if(a.n = 0D, 0D, a.v * x.v),
            'changes', a.changes + if(a.n = 0D or a.kind = x.kind, 0D, 1D)))"""


def _equal_pairs(run: str) -> str:
    """SQL for the number of pairs of equal symbols."""
    return f"""aggregate(array_sort(filter(split(rtrim('=', {run}), ''), c -> c <> '')),
        named_struct('last', '', 'same', 0D, 'pairs', 0D),
        (a, c) -> named_struct('last', c, 'same', if(c = a.last, a.same + 1D, 0D), 'pairs', a.pairs + if(c = a.last, a.same + 1D, 0D)),
        a -> a.pairs)"""


def _steps(z: str) -> str:
    """SQL for the p-value of an upper tail in steps of a tenth of a decade, rounded towards 1."""
    ln10 = math.log(10)
    tail = f"(({z}) * ({z}) / 2 / {ln10} + log10(sqrt(2 * pi()) * (({z}) + sqrt(({z}) * ({z}) + 4)) / 2))"
    return f"cast(if(({z}) > 0, greatest(0D, floor({STEPS} * {tail})), 0D) as int)"


def scored(rows: DataFrame) -> DataFrame:
    """``doc_id, base, runs`` from ``doc_id, text``: base spans, and the runs that pass the battery with their p-values.

    Runs that fail the battery or overlap a base span stay in the list with step 0: they count as tests.
    """
    shown = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shown = shown.select("doc_id", base_spans("text").alias("base"), F.expr(_found("text", RUN, 3)).alias("runs"))
    one = "transform(runs, r -> named_struct('start', r.start, 'stop', r.stop, 'found', r.found, 'alphabet', %s))" % _alphabet("r.found")
    shown = shown.withColumn("runs", F.expr(one))
    battery = _battery("r.found").replace("alphabet", "r.alphabet")
    shown = shown.withColumn(
        "runs",
        F.expr(f"""transform(runs, r -> named_struct('start', r.start, 'stop', r.stop, 'k', cast(length(r.alphabet) as double),
            's', {battery}, 'pairs', {_equal_pairs('r.found')}))"""),
    )
    chi = "((r.k * (2 * r.pairs + r.s.n) / r.s.n - r.s.n) - (r.k - 1)) / sqrt(2 * (r.k - 1) * (r.s.n - 1) / r.s.n)"
    low = "(r.s.n - r.s.high)"
    mean = f"(2 * r.s.high * {low} / r.s.n + 1)"
    middle = f"if(r.s.high * {low} = 0, 99D, abs(r.s.runs - {mean}) / sqrt(greatest(1D, ({mean} - 1) * ({mean} - 2) / (r.s.n - 1))))"
    spread = "(r.s.squares - r.s.sum * r.s.sum / r.s.n)"
    serial = f"if({spread} <= 0, 99D, abs((r.s.cross - (r.s.n - 1) / r.s.n * r.s.sum * r.s.sum / r.s.n) / {spread}) * sqrt(r.s.n))"
    shown = shown.withColumn(
        "runs",
        F.expr(f"""transform(runs, r -> named_struct('start', r.start, 'stop', r.stop, 'n', r.s.n,
            'random', r.s.n > 1 and {chi} <= {BATTERY_Z} and {middle} <= {BATTERY_Z} and {serial} <= {BATTERY_Z}
                and not exists(base, b -> b.start < r.stop and r.start < b.stop),
            'few', ({WORD_PAIRS} * r.s.n * (r.s.n - 1) / 2 - r.pairs)
                / sqrt(r.s.n * (r.s.n - 1) / 2 * {WORD_PAIRS * (1 - WORD_PAIRS)} + r.s.n * (r.s.n - 1) * (r.s.n - 2) * {WORD_THIRD - WORD_PAIRS**2}),
            'mixed', (r.s.changes - {WORD_CHANGES} * (r.s.n - 1)) / sqrt(greatest(1D, r.s.n - 1) * {WORD_CHANGES * (1 - WORD_CHANGES)})))"""),
    )
    both = "(r.few + r.mixed) / sqrt(2D)"  # Stouffer's sum of two independent signs
    band = "size(filter(array(%s), x -> x <= r.n)) - 1" % ", ".join(map(str, BANDS))
    return shown.select(
        "doc_id",
        F.expr("transform(base, b -> named_struct('start', b.start, 'kind', b.kind, 'stop', b.stop))").alias("base"),
        F.expr(
            f"transform(runs, r -> named_struct('start', r.start, 'kind', 3, 'stop', r.stop, 'band', {band}, "
            f"'step', if(r.random, {_steps(both)}, 0)))"
        ).alias("runs"),
    )


def limits(found: DataFrame) -> dict[int, int]:
    """The least step that counts as a finding in each length band, by Benjamini-Hochberg over the corpus.

    Only counts per band and step reach the driver: four bands, and steps that are bounded by the longest run's p-value.
    """
    capped = F.least("r.step", F.lit(20 * STEPS))  # nothing beyond is ever needed as a limit
    counts = found.select(F.explode("runs").alias("r")).groupBy(F.col("r.band").alias("band"), capped.alias("step")).count().collect()
    chosen = {}
    for band in {r["band"] for r in counts}:
        own = sorted(((r["step"], r["count"]) for r in counts if r["band"] == band), reverse=True)
        tests, passed = sum(n for _, n in own), 0
        for step, n in own:
            passed += n
            if step > 0 and tests * 10 ** (-step / STEPS) <= FALSE_SHARE * passed:
                chosen[band] = step
    return chosen


def chosen_spans(limit: dict[int, int]) -> Column:
    """Base spans and the random runs beyond their band's limit, by start, then kind."""
    test = " or ".join(f"(r.band = {band} and r.step >= {step})" for band, step in sorted(limit.items())) or "false"
    added = f"transform(filter(runs, r -> {test}), r -> named_struct('start', r.start, 'kind', r.kind, 'stop', r.stop))"
    return F.expr(f"array_sort(concat(base, {added}))")


def written(spans: str) -> str:
    """SQL for kind:start:stop, joined by commas."""
    names = "array(%s)" % ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat_ws(':', {names}[x.kind], x.start, x.stop)), ',')"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` of every row. The narrow findings are written once; texts are read once."""
    found = stored(scored(docs.select("doc_id", F.col("text").cast("string").alias("text"))), "secret-runs")
    return found.select("doc_id", "base", chosen_spans(limits(found)).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every found stretch replaced by the mark, all columns kept.

    The limits come from a first pass over the corpus; the second pass finds the spans beside each text, so that rows
    need no key. Overlapping spans are replaced as one.
    """
    kept = docs.columns
    limit = limits(scored(docs.select(F.lit(0).alias("doc_id"), F.col("text"))))
    inner = scored(docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc_id"), F.col("text")))
    spans = inner.select(F.col("doc_id").alias("row"), chosen_spans(limit).alias("spans"))
    merged = """aggregate(spans, cast(array() as array<struct<start: int, stop: int>>), (a, x) ->
        if(size(a) > 0 and x.start <= element_at(a, -1).stop,
            concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'stop', greatest(element_at(a, -1).stop, x.stop)))),
            concat(a, array(named_struct('start', x.start, 'stop', x.stop)))))"""
    joined = spans.select("row", F.expr(merged).alias("cuts"))
    quoted = _text_literal(mark)
    text = f"""if(size(cuts) = 0, row.text, concat(
        array_join(transform(cuts, (x, i) -> concat(substring(row.text, if(i = 0, 1, cuts[i - 1].stop + 1), x.start - if(i = 0, 0, cuts[i - 1].stop)), {quoted})), ''),
        substring(row.text, element_at(cuts, -1).stop + 1)))"""
    out = joined.select("row", F.expr(text).alias("clean"))
    fields = [F.col("clean").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in kept]
    return out.select(*fields)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base spans, and all spans."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.expr(f"cast(size(filter(base, x -> x.kind = {kind})) as bigint)")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.expr(written("base")), 256).alias("base_sha256"),
        F.expr(written("spans")).alias("spans"),
    )
