"""Word lists, patterns and constants that results depend on, stated as they are.

Patterns are in Java's dialect.  (?U) gives \\w, \\b and \\s their Unicode meaning, (?d) leaves only \\n as a line end.
"""

FACT_TYPES = ("numeric", "semantic", "date", "time", "boolean", "entity")
LABELS = ("corroborates", "contradicts", "reconciled", "insufficient_context", "unrelated")
LABEL_ALIASES = {
    "corroborate": "corroborates",
    "contradict": "contradicts",
    "reconcile": "reconciled",
    "not_comparable": "insufficient_context",
    "not-comparable": "insufficient_context",
    "insufficient": "insufficient_context",
}

STOP_WORDS = (
    "the a an of and or for to in on by at is are was were be been being has had have do does did will would could should "
    "may might shall can that this with from as its it not no"
).split()

NUMBER = r"\d{1,3}(?:,\d{3})*(?:\.\d+)?"
SIGNED_NUMBER = r"[-+]?\d{1,3}(?:,\d{3})*(?:\.\d+)?"
MONEY = r"(?:₹|Rs\.?|USD|US\$|\$|€|£)?\d{1,3}(?:,\d{3})*(?:\.\d+)?"
SCALES = (("billion", 1_000_000_000.0), ("million", 1_000_000.0), ("crore", 10_000_000.0), ("lakh", 100_000.0))

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ISO_DATE = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
NUMERIC_DATE = r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})|([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})"
DAY_MONTH = r"(?U)\b([0-9]{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+)\s+([0-9]{4})\b"
MONTH_DAY = r"(?U)\b([A-Za-z]+)\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})\b"
CLOCK = r"([0-9]{1,2})(?::([0-9]{2}))?\s*(AM|PM|am|pm)?"
CLOCK_SEPARATOR = r"(?:\s*[-–—~]\s*|\s+(?:to|until|through|from)\s+)"
ISO_CLOCK = r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?$"

TRUE_WORDS = ("true", "yes", "1", "positive", "present", "active")
FALSE_WORDS = ("false", "no", "0", "negative", "absent", "inactive")

CLAIM_EDGES = r"[ \t\n·•\-–—]"
PLACEHOLDER = (
    r"(?iUd)\[.+\]|\{.+\}|<.+>|XXX+|\*{2,}|\b(?:TBD|TODO|PLACEHOLDER|REDACTED|MASKED|N\.?A\.?)\b"
    r"|XXXX[\-/]?XXXX[\-/]?XXXX|\*{2,}[\-/]?\*{2,}[\-/]?\*{2,}|\d{4}[\-/]\*{4}[\-/]\*{4}"
)
CREDENTIAL = (
    r"(?iUd)(?:password|passwd|pwd|secret|token|api[_\s]?key|access[_\s]?key|auth[_\s]?key|private[_\s]?key"
    r"|bearer|credential|login|authorization)\s*[:=]\s*\S+|\bBearer\s+[A-Za-z0-9._~+/=-]+|\b(?:jwt|oauth|csrf)[\s_-]*token\b"
)
DOCUMENT_META = (
    r"(?iUd)^(?:page|folio|sheet)\s*\d+\s*(?:of\s*\d+)?\s*$|^(?:footer|header|watermark)\s*[:\-]?\s*\S*$"
    r"|^(?:draft|final|version|rev\.?|v\d+)\s*$"
)
LABEL_TITLE = (
    r"(?iUd)^(?:section|chapter|part|item|clause|page|article|appendix|annexure|annex|figure|table|column|row|field|title|heading"
    r"|schedule|exhibit|entry|line)\s+[0-9IVX]+$"
)
REFERENCE = (
    r"(?iUd)^(?:(?:registration|reg(?:istered)?|ref(?:erence)?|serial|account|invoice|policy|voucher|bill|file|case|permit|license"
    r"|licence|passport|roll|seat|token|tracking|order|transaction|certificate|document|folio|employee|investor|report)\s+)?"
    r"(?:#|no\.?|number|id|code|identifier)\s*[:#]?\s*[A-Za-z0-9][A-Za-z0-9\-/._]{2,}$"
)
BARE_CODE = r"^[A-Za-z0-9/\-]{5,}$"
BARE_NUMBER = r"(?U)^[\d\s,.\-/()+:]+$"

PLAN = (
    r"(?iU)\b(plan(?:ned|s|ning)?|expected|expects|projected|proposed|covers?|will|scheduled|target(?:ed)?|originally|planned"
    r"|anticipat(?:es|ed))\b"
)
ACTUAL = (
    r"(?iU)\b(entered|found|recorded|reported|actual(?:ly)?|spent|delivered|completed|received|increased|declined|received"
    r"|resulted|achieved|occurred|entered service)\b"
)
CONTRAST = r"(?iU)\b(?:rather than|instead of|as opposed to|as against|versus|vs\.?)\s+(?:approximately|about|the\s+)?([0-9][0-9,]*(?:\.[0-9]+)?)"
SCOPE = (
    r"(?iU)\b(standalone|consolidated|full[- ]year|annual|quarterly|first half|second half|phase[ s0-9]*|total|overall|combined"
    r"|excluding?|including|approximately|roughly|as of|unadjusted|adjusted|cumulative|budgeted|approved)\b"
)
CUMULATIVE = r"(?iU)\b(cumulative|year[- ]to[- ]date|ytd|running total|accrued|to date)\b"
REVISED = (
    r"(?iU)\b(revised|revision|restated|recast|updated (?:estimate|projection|forecast)?|upward(?:ly)? (?:revised|adjusted)"
    r"|downward(?:ly)? (?:revised|adjusted)|superseded|initially (?:estimated|projected)|earlier (?:estimate|projection))\b"
)
APPROXIMATE = (
    r"(?iU)\b(approximately|approx|about|around|roughly|nearly|almost|close to|on the order of|circa|some|several|approx\.|~|around"
    r"|estimated at)\b"
)
NEGATION = r"(?iU)\b(not|no|never|did not|didn't|does not|doesn't|failed to|none|lack of|absence of|without|no longer)\b"
CAUSAL = (
    r"(?iU)\b(consequently|results? in|resultant|leads? to|lead to|caused|causes|causal|because of|due to|driven by|attributable to"
    r"|responsible for|precipitated|spurred|propelled|brought about|account for)\b"
)
CORRELATION = (
    r"(?iU)\b(correlat(?:ed|es|ion)?|associated?|association|related?|linked|tied to|coincid(?:ed|es)?|tracks|moves with|accompanies"
    r"|co-occur)\b"
)
PERCENT_POINT = r"(?iU)\b(percentage points?|pp|pbp)\b"

#: What an explanation of a label says; in order of precedence.
EXPLAINS = (
    (
        "insufficient_context",
        r"(?iU)\b(insufficient|cannot (?:determine|confirm|establish|verify)|not enough|unclear|unknown|missing|lack of context"
        r"|no (?:information|evidence|basis)|unable to (?:confirm|establish|determine)|not stated|not provided)\b",
    ),
    ("contradicts", r"(?iU)\b(conflict|incompatib|mutually exclusive|contradict|disagree|discrepan|contrary)\b"),
    (
        "reconciled",
        r"(?iU)\b(reconcil|explained by|explained through|different (?:scope|period|time|unit|definition|basis|measurement|reporting"
        r"|estimat|plan|actual|cumulative)|planned.vs.actual|revised|restated|approximate|rounding|progression|chronolog"
        r"|can both be true|standalone|consolidated)\b",
    ),
    (
        "corroborates",
        r"(?iU)\b(consistent|agrees?|agree|agreement|corroborat|support|confirm|matching|compatible|aligned?|alike|the same as"
        r"|both (?:state|report|indicate|show))\b",
    ),
)
SUPPORT = {
    "corroborates": "The two facts independently support substantially the same proposition and are consistent after alignment.",
    "contradicts": "The facts assert mutually incompatible claims for the same entity, metric, scope, and time period, and no contextual distinction explains the difference.",
    "reconciled": "The apparent difference between the facts is explained by explicit context present in the facts.",
    "insufficient_context": "The available evidence is insufficient to establish whether the facts reconcile or contradict.",
}
#: Reasons that the rules give, by rule number (6 has one for each outcome).
REASONS = {
    "1": "the two values are consistent (equal, or compatible allowing for rounding/approximation), so the facts agree",
    "2": "the differing values are explained by an explicit contextual distinction in the facts (planned-versus-actual, cumulative progression, a revised estimate, a different reporting period/scope, approximation, units, or percentage-point basis), so both facts can be true at once",
    "3": "one fact asserts causation while the other only notes a correlation or outcome; these are different kinds of claim and both can be true",
    "4": "neither fact provides a reporting period, so it cannot be established whether the values refer to the same time scope; the difference may be chronological, scope-based, or actual",
    "5": "the values differ, but the available context is not enough to confirm the facts refer to the same entity, metric, scope, and comparable time period",
    "6 contradicts": "the values are mutually incompatible and neither fact supplies any distinguishing context",
    "6 corroborates": "the values are consistent and neither fact supplies any distinguishing context",
}
#: Keys of a raw fact with a meaning of their own; all others go into the context.
KNOWN_KEYS = ("claim", "text", "fact_type", "value", "unit", "verbatim_quote", "evidence", "confidence", "entity", "time_period", "scope")
