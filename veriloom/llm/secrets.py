"""Secret scanning with DataFrame functions only.

Two layers find spans.  Fixed patterns (`assign`, `access`, `hex`) give the base spans.  The entropy layer looks at every
maximal run of key-like characters that is left between the base spans, slides a window over it, keeps the Shannon entropy of the window up to
date by incremental counts, and reports runs whose best window passes the threshold of its character class, unless an
allow-list rule explains the part of the run (between slashes and equals signs) that the window lies in.

Defined results: a null text counts as empty; a text without findings has an empty span list; repeated rows are scanned
each on their own; extra columns pass through, those named like the added ones are replaced; empty tables give empty tables.  Offsets are
code points, ends exclusive.  The scan is a projection: no shuffle, no Python, whole texts; its time grows with a text's length, however many spans it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in the order in which spans with one start are listed, and the patterns of the base kinds.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: (class, what all of its runs look like, bits a window needs); the first class that fits a run counts.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", 3.0),
    ("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 3.7),
    ("token", r"^(?=.*[0-9].*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z]).+$", 3.9),
)
#: Runs that look random but are known to be harmless.
ALLOW = (
    r"(?i)(example|sample|dummy|placeholder|changeme|your[_-]?key|lorem|redacted|x{6,}|0123456789|abcdefghij)",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]+([/_=+-]+[A-Za-z]+)*$",
    r"^[0-9/_=+-]+$",
)
#: Stands for a character of a span that was found already; no pattern has it.
MARK = "\u0001"
FOLD = 256
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: what a lambda mentions is computed anew at each of its steps."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _zipped(text: Column, between: Column, pattern: str, group: int) -> Column:
    """All matches as (gap before it, hit, group)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    extra = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    return F.arrays_zip(F.slice(between, F.lit(1), F.size(between) - 1).alias("gap"), hits.alias("hit"), extra.alias("extra"))


def _located(text: Column, pattern: str, rank: int, group: int = 0) -> Column:
    """All matches of a pattern as (start, rank, end, hit, extra): a split gives what lies between them, so offsets add up."""
    kind = "array<struct<start:int,rank:int,end:int,hit:string,extra:string>>"

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.char_length(part["gap"])
        end = start + F.char_length(part["hit"])
        found = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), part["hit"].alias("hit"), part["extra"].alias("extra"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(found)).cast(kind).alias("found"))

    none = F.array().cast(kind)
    state = lambda at, found: F.struct(at.alias("at"), found.alias("found"))

    def folded(parts: Column) -> Column:
        """In runs of FOLD parts, so that a long list isn't copied for each of its elements."""
        run = lambda done, b: F.aggregate(F.slice(parts, b * FOLD + 1, F.lit(FOLD)), state(done["at"], none), step, lambda s: state(s["at"], F.concat(done["found"], s["found"])))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / FOLD).cast("int")), state(F.lit(0), none), run, lambda s: s["found"])

    parts = _bound(F.split(text, pattern, -1), lambda between: _zipped(text, between, pattern, group))
    return F.when(text.rlike(pattern), _bound(parts, folded)).otherwise(none)


def _masked(text: Column, pattern: str, good: Callable[[Column], Column], group: int = 0) -> Column:
    """The text with as many marks as characters in place of each good match."""
    written = lambda p: F.concat(p["gap"], F.when(good(p), F.repeat(F.lit(MARK), F.char_length(p["hit"]))).otherwise(p["hit"]))
    put = lambda between: F.concat(F.array_join(F.transform(_zipped(text, between, pattern, group), written), ""), F.element_at(between, -1))
    return F.when(text.rlike(pattern), _bound(F.split(text, pattern, -1), put)).otherwise(text)


def _without_base(text: Column) -> Column:
    """The text with its base spans masked."""
    every = lambda p: F.lit(True)
    one = _masked(text, ASSIGN, lambda p: F.char_length(p["extra"]) >= ASSIGN_MIN, 2)
    return _bound(_bound(one, lambda t: _masked(t, ACCESS, every)), lambda t: _masked(t, HEX, every))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))).cast(SPAN)


def best_window(run: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any window of a run of ASCII characters (all of it, if it is shorter), and where that window ends.

    The state holds a count for each character and the sum of c*log2(c); one character enters and one leaves at a step.
    """

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def put(counts: Column, at: Column, value: Column) -> Column:
        return F.concat(F.slice(counts, F.lit(1), at), F.array(value), F.slice(counts, at + 2, F.lit(128)))

    def slide(codes: Column) -> Column:
        width = F.least(F.lit(window), F.size(codes))

        def step(state: Column, i: Column) -> Column:
            new = F.element_at(codes, i)
            old = F.when(i > width, F.element_at(codes, F.greatest(i - width, F.lit(1)))).otherwise(F.lit(-1))
            enters = F.element_at(state["n"], new + 1)
            leaves = F.when(old >= 0, F.element_at(state["n"], F.greatest(old, F.lit(0)) + 1) + F.when(old == new, 1).otherwise(0)).otherwise(F.lit(0))
            total = state["sum"] + weight(enters + 1) - weight(enters) + F.when(old >= 0, weight(leaves - 1) - weight(leaves)).otherwise(F.lit(0.0))
            bits = F.log2(width.cast("double")) - total / width
            better = (i >= width) & (bits > state["bits"])
            counts = F.when(old == new, state["n"]).when(old < 0, put(state["n"], new, enters + 1)).otherwise(put(put(state["n"], new, enters + 1), old, leaves - 1))
            return F.struct(counts.alias("n"), total.alias("sum"), F.when(better, bits).otherwise(state["bits"]).alias("bits"), F.when(better, i).otherwise(state["end"]).alias("end"))

        begin = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("bits"), width.alias("end"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), begin, step, lambda s: F.struct(s["bits"].alias("bits"), s["end"].alias("end"), width.alias("width")))

    return _bound(F.transform(F.split(run, ""), lambda c: F.ascii(c)), slide)


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    return best_window(run, window)["bits"]


def _random_looking(run: Column) -> Column:
    """Whether the best window has the bits that its part of the run needs, and no rule explains that part."""

    def judged(part: Column, bits: Column) -> Column:
        allowed = F.lit(False)
        for rule in ALLOW:
            allowed = allowed | part.rlike(rule)
        need = F.lit(None).cast("double")
        for _, shape, least in reversed(CLASSES):
            need = F.when(part.rlike(shape), F.lit(least)).otherwise(need)
        return F.coalesce(~allowed & (bits >= need), F.lit(False))

    def part(best: Column) -> Column:
        """Between slashes and equals signs around the window's middle; if that is short, around the whole window."""

        def around(first: Column, last: Column) -> Column:
            before, inside, after = F.substring(run, F.lit(1), first - 1), F.substring(run, first, last - first + 1), F.substring(run, last + 1, F.char_length(run))
            return F.concat(F.regexp_extract(before, "[^/=]*$", 0), inside, F.regexp_extract(after, "^[^/=]*", 0))

        middle = best["end"] - F.floor(best["width"] / 2).cast("int")
        return _bound(F.regexp_replace(around(middle, middle), "^[/=]", ""), lambda p: F.when(F.char_length(p) * 2 >= best["width"], p).otherwise(around(best["end"] - best["width"] + 1, best["end"])))

    found = _bound(best_window(run), lambda best: _bound(part(best), lambda p: judged(p, best["bits"])))
    return F.when(run.rlike("[0-9]") & run.rlike("[A-Za-z]"), found).otherwise(F.lit(False))


def _base(text: Column) -> Column:
    assign = F.filter(_located(text, ASSIGN, 0, 2), lambda s: F.char_length(s["extra"]) >= ASSIGN_MIN)
    return F.array_sort(F.concat(_plain(assign), _plain(_located(text, ACCESS, 1)), _plain(_located(text, HEX, 2))))


def _entropy(text: Column) -> Column:
    return _plain(_bound(_without_base(text), lambda t: F.filter(_located(t, CANDIDATE, 3), lambda s: _random_looking(s["hit"]))))


def scan(docs: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "all_spans") -> DataFrame:
    """Add two columns of (start, rank, end), sorted: what the patterns found, and that with the entropy layer's spans.

    rank is the place of the kind in KINDS.  A span of the entropy layer never overlaps one that the patterns found first.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(base, _base(t)).withColumn(spans, F.array_sort(F.concat(F.col(base), _entropy(t))))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """Replace each found span (overlapping and adjacent ones together) by a mark; texts without findings, null ones too, stay as they are."""
    t = F.coalesce(F.col(text), F.lit(""))
    masked = _bound(_without_base(t), lambda v: _masked(v, CANDIDATE, lambda p: _random_looking(p["hit"])))
    clean = _bound(masked, lambda v: F.when(v == t, F.col(text)).otherwise(F.regexp_replace(v, f"{MARK}+", mark)))
    # a text that has the masking character itself is cut span by span
    spans = F.array_sort(F.concat(_base(t), _entropy(t)))

    def step(state: Column, s: Column) -> Column:
        kept = F.when(s["start"] > state["at"], F.substring(t, state["at"] + 1, s["start"] - state["at"])).otherwise(F.lit(""))
        added = F.when(s["start"] > state["at"], F.concat(kept, F.lit(mark))).when((s["start"] == 0) & (state["at"] == 0), F.lit(mark)).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], added).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    slow = F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.char_length(t))))
    return docs.withColumn(text, F.when(F.instr(t, MARK) > 0, slow).otherwise(clean))
