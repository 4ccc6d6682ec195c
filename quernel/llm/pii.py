"""Personal data by weak supervision (operator 7).

Four kinds of spans: email, ip, card, phone.  Base spans follow fixed patterns with
their checks and always stay; matches that fail their check are never spans of that kind.
Matches of wider patterns (addresses with the at sign or dots in brackets or words, defanged
quads and IPv6, cards with other separators, national and 00 phone numbers) are candidates.
On every candidate six labelers vote or abstain: a stricter pattern, a gazetteer (top-level
domains, issuer digits, reserved networks, area codes), the shape, cue words before, cue
words after, and the characters around.  Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability and each pattern's probability.  It starts from
the votes on a fixed set of written examples and look-alikes (:func:`seeds`), which count as
:data:`SEED_WEIGHT` candidates each, so that what is rare in a corpus is judged alike whatever
else the corpus holds, and only many candidates can move the estimates.  A logistic span
classifier, which sees none of the votes but only features of the span's form (digits, groups,
separators, variety, length, start, check digit, neighbours), is trained on these
probabilities and on the examples.  A candidate is added if the classifier accepts it and the
labelers of its content (pattern, gazetteer, shape) are for it rather than against it, unless it
overlaps a base span.

Everything that touches rows is DataFrame operations, without a shuffle of texts.  To
the driver come counts of vote patterns (at most 3**6 a kind) and, for each combination
of features, a count and a mean probability; the number of both is fixed by the labelers
and features, whatever the corpus.  Positions come from the lengths of the texts between
matches, so no text is searched again for a match's place.

Null texts count as empty; a text without spans has counts 0 and empty strings.  Very
long texts are searched whole; all patterns take linear time.  Repeated rows give equal
results, equal probabilities are ties that share one decision.  An empty table gives an
empty result.  Extra columns are kept, under whatever names; ``base`` and ``spans`` are replaced.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import free_name, scratch, staged

KINDS = ("email", "ip", "card", "phone")

#: The base patterns in possessive form, which match the same spans
#: in linear time.  A run is entered at its start, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

#: Wider patterns, and cheap tests that keep most texts away from them.
AT = r"(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)"
DOT = r"(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20|\.)"
WIDE = {
    "email": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++{AT}[a-z0-9-]++(?:{DOT}[a-z0-9-]++)++",
    "ip": rf"(?i)(?<![0-9a-f:.])(?:[0-9]{{1,3}}(?:\x20?[\[(]\x20?(?:dot|\.)\x20?[\])]\x20?[0-9]{{1,3}}){{3}}|(?:[0-9a-f]{{1,4}}:){{7}}[0-9a-f]{{1,4}})(?![0-9a-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:([./_]|\x20{2}|\x20-\x20)[0-9]{4})(?:\1[0-9]{4})\1[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+.(-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|00[1-9][0-9]{0,2}[\x20/-][0-9\x20/-]{6,14}[0-9]|0[1-9][0-9]{1,4}[\x20/-]{1,3}[0-9]{5,9})(?![0-9.-][0-9]|[0-9])",
}
NEEDS = {
    "email": r"(?i)(?:[\[({]\x20?at\x20?[\])}]|\x20at\x20[a-z0-9-]+(?:\.|\x20?[\[({]|\x20dot\x20))",
    "ip": r"(?i)[0-9]\x20?[\[(]\x20?(?:dot|\.)|:[0-9a-f]{1,4}:[0-9a-f]{1,4}:",
    "card": r"[0-9]{4}(?:[./_]|\x20{2}|\x20-\x20)[0-9]{4}",
    "phone": r"[0-9]{2}\)?[\x20./-]{1,3}[0-9]{3}",
}

BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Gazetteers and cue words: fixed values.
TOP_LEVEL = r"(?i)[\x20.\])}](?:com|org|net|edu|gov|mil|int|info|biz|name|io|co|me|dev|app|ai|tv|cc|us|ca|mx|br|ar|cl|uk|ie|de|at|ch|fr|be|nl|lu|es|pt|it|gr|pl|cz|sk|hu|ro|bg|se|no|fi|dk|is|ee|lv|lt|ua|ru|tr|il|in|cn|jp|kr|tw|hk|sg|au|nz|za|eu)$"
RESERVED_NETWORK = r"^(?:0|10|127|22[4-9]|2[345][0-9]|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."
ISSUER = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3(?:0|6|8)[0-9]{12,17}|6(?:0|2|4|5)[0-9]{14,17})$"
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|adres|correo|courriel|schreib)[^.!?\n]*$",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse|login|client|peer|from)[^.!?\n]*$",
    "card": r"(?i)(?:card|visa|credit|payment|karte|tarjeta|carte|amex)[^.!?\n]*$",
    "phone": r"(?i)(?:phone|tel|call|ring|mobile|fax|contact|anruf|appel|llam)[^!?\n]*$",
}
COUNTER_CUES = r"(?i)(?:token|version|licen[cs]e|isbn|issn|order|invoice|serial|hash|key|part|build|release|section|article|parcel|ticket|case|sum|total|price)\b[^.!?\n]{0,12}$"
FOLLOWS = r"(?i)^\W{0,2}(?:\(?(?:home|work|office|mobile|private|direct)\b|ext\b|any ?time|exp\b|cvv\b)"
COUNTER_FOLLOWS = r"(?i)^(?:\x20?(?:%|eur\b|usd\b|kg\b|km\b|ms\b|px\b|mb\b|items?\b|pages?\b|units?\b|beta\b|alpha\b|rc[0-9])|[/\\=])"

CONTEXT, AFTER = 40, 12
LABELERS = ("pattern", "listed", "shape", "before", "after", "around")
#: Those that look at the span itself.
CONTENT = ("pattern", "listed", "shape")
FEATURES = ("digits", "groups", "separator", "variety", "length", "start", "check", "left", "right")
MATCH = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def spans_by(text: Column, pattern: str) -> Column:
    """All leftmost matches with places in code points: array of (start, end, match, before, after).

    Prefix sums of lengths go over blocks of about the square root of their number,
    so texts with very many matches stay cheap.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.transform(F.array(F.struct(matches.alias("m"), gaps.alias("g"))), lambda x: _placed(x["m"], x["g"]))
    return both[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _placed(m: Column, g: Column) -> Column:
    n = F.size(m)
    steps = F.array(F.struct(F.zip_with(F.slice(g, 1, F.greatest(n, F.lit(1))), m, lambda a, b: F.char_length(a) + F.coalesce(F.char_length(b), F.lit(0))).alias("s"), F.ceil(F.sqrt(n)).cast("int").alias("b")))

    def within(x: Column) -> Column:
        s, b = x["s"], x["b"]
        sums = F.array(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / b).cast("int")), lambda k: _total(F.slice(s, k * b + 1, b))))

        def at(t: Column, i: Column) -> Column:
            block = F.floor(i / b).cast("int")
            start = _total(F.slice(t, F.lit(1), block)) + _total(F.slice(s, block * b + 1, i - block * b)) + F.char_length(F.get(g, i))
            match = F.get(m, i)
            return F.struct(start.alias("start"), (start + F.char_length(match)).alias("end"), match.alias("match"), F.right(F.get(g, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(g, i + 1), F.lit(AFTER)).alias("after"))

        return F.transform(sums, lambda t: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(t, i)))[0]

    return F.when(n > 0, F.transform(steps, within)[0]).otherwise(F.array().cast(MATCH))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    values = F.transform(F.split(F.reverse(digits), "(?!^)"), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return _total(doubled) % 10 == 0


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, -1)).otherwise(0)


def plain_quad(match: Column) -> Column:
    """A dotted quad as it would be without its disguise."""
    return F.regexp_replace(match, r"(?i)\x20?[\[(]\x20?(?:dot|\.)\x20?[\])]\x20?", ".")


def passes(kind: str, match: Column) -> Column:
    """The check of a base match."""
    digits = digits_of(match)
    many = F.char_length(digits)
    if kind == "ip":
        return match.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return many.between(14, 19) & luhn(digits)
    return many.between(10, 15) if kind == "phone" else F.lit(True)


def _votes(kind: str, x: Column) -> dict[str, Column]:
    """The labelers' votes on one candidate: 1 personal data, -1 not, 0 abstains."""
    match, digits = x["match"], digits_of(x["match"])
    many = F.char_length(digits)
    if kind == "email":
        bracketed = match.rlike(rf"(?i)[\[({{]\x20?at")
        pattern = _vote(bracketed, ~bracketed & ~match.rlike(r"(?i)\x20dot\x20|[\[({]\x20?(?:dot|\.)"))
        listed = _vote(match.rlike(TOP_LEVEL), ~match.rlike(TOP_LEVEL))
        marked, local = match.rlike(r"@|[\[({]|(?i)\x20dot\x20"), match.rlike(r"(?i)^[a-z0-9._%+-]*[a-z]")
        shape = _vote(marked & local & match.rlike(r"(?i)[a-z]{2,}$"), ~marked | ~local | ~match.rlike(r"(?i)[a-z]$"))
    elif kind == "ip":
        quad, six = plain_quad(match), match.contains(":")
        good = quad.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
        pattern = _vote(six | good, ~six & ~good)
        listed = _vote(good & ~quad.rlike(RESERVED_NETWORK) | match.rlike(r"(?i)^(?:2[0-9a-f]{3}|3[0-9a-f]{3}|fe80|f[cd][0-9a-f]{2}):"), quad.rlike(RESERVED_NETWORK) | ~good & ~six)
        shape = _vote(six | good & ~quad.rlike(r"(?:^|\.)0[0-9]"), ~six & (~good | quad.rlike(r"(?:^|\.)0[0-9]")))
    elif kind == "card":
        pattern = _vote(many == 16, many < 14)
        listed = _vote(digits.rlike(ISSUER), ~digits.rlike(ISSUER))
        shape = _vote(luhn(digits), ~luhn(digits))
    else:
        good = many.between(10, 15)
        pattern = _vote(match.rlike(r"^\(|^00|/|-"), match.rlike(r"\.[0-9]{3}\."))
        listed = _vote(match.rlike(r"^00[1-9]|^0[1-9]") | digits.rlike("^[2-9][0-9]{2}[2-9]"), digits.rlike("^(?:[2-9][0-9]{2}[01]|[2-9]11|1|0[01][0-9])"))
        shape = _vote(good & match.rlike(r"[\x20()/-]"), ~good | match.rlike(r"\.[0-9]{3}\."))
    left, right = F.right(x["before"], F.lit(1)), F.left(x["after"], F.lit(1))
    glued = r"[\p{L}0-9_=\"#$/]"
    return {
        "pattern": pattern,
        "listed": listed,
        "shape": shape,
        "before": F.when(x["before"].rlike(COUNTER_CUES), -1).otherwise(_vote(x["before"].rlike(CUES[kind]))),
        "after": _vote(x["after"].rlike(FOLLOWS), x["after"].rlike(COUNTER_FOLLOWS)),
        "around": _vote(~left.rlike(glued) & ~right.rlike(glued), left.rlike(glued) | right.rlike(glued)),
    }


def _step(c: Column, *limits: int) -> Column:
    """How many of the ascending ``limits`` a number reaches."""
    return sum(((c >= limit).cast("int") for limit in limits), F.lit(0))


def _check(kind: str, match: Column) -> Column:
    """Whether the parts of a candidate have values that its kind allows."""
    digits = digits_of(match)
    if kind == "email":
        return match.rlike(r"(?i)[\x20.\])}][a-z]{2,4}$")
    if kind == "ip":
        return match.contains(":") | passes("ip", plain_quad(match))
    return luhn(digits) if kind == "card" else digits.rlike("^(?:00?[1-9]|[2-9][0-9]{2}[2-9])")


def _features(kind: str, x: Column) -> dict[str, Column]:
    """Small discrete features of a candidate's form for the span classifier."""
    match, digits = x["match"], digits_of(x["match"])
    neighbour = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[.,;:!?()]"), 2).otherwise(3)
    groups = F.size(F.regexp_extract_all(match, F.lit(r"[A-Za-z0-9]+"), F.lit(0)))
    start = F.when(match.startswith("+"), 10).when(match.startswith("("), 11).otherwise(F.coalesce(F.left(match, F.lit(1)).try_cast("int"), F.lit(12)))
    separator = F.when(match.rlike(r"[\[{]|\([a-z.]"), 4).when(match.contains("@"), 5).when(match.contains(":"), 6).when(match.rlike(r"\x20"), 3).when(match.contains("."), 2).when(match.rlike("[^0-9A-Za-z]"), 1).otherwise(0)
    return {
        "digits": _step(F.char_length(digits), 1, 8, 10, 11, 12, 13, 14, 16, 17, 20),
        "groups": _step(groups, 2, 3, 4, 5, 6, 8),
        "separator": separator,
        "variety": _step(F.size(F.array_distinct(F.split(digits, "(?!^)"))), 3, 5),
        "length": _step(F.char_length(match), 8, 12, 16, 24, 40),
        "start": start,
        "check": _check(kind, match),
        "left": neighbour(F.right(x["before"], F.lit(1))),
        "right": neighbour(F.left(x["after"], F.lit(1))),
    }


def _labelled(kind: str, spans: Column) -> Column:
    def label(x: Column) -> Column:
        votes = F.struct(*[v.cast("int").alias(k) for k, v in _votes(kind, x).items()])
        features = F.struct(*[v.cast("int").alias(k) for k, v in _features(kind, x).items()])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(False).alias("base"), votes.alias("votes"), features.alias("features"))

    return F.transform(spans, label)


def candidates(docs: DataFrame, names: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` with a column for each kind, named by ``names``: its base spans, and candidates with votes and features."""
    base, wide = ({k: free_name(docs, f"{names[k]}_{w}") for k in KINDS} for w in ("base", "wide"))
    body, digit = free_name(docs, "__pii_text"), free_name(docs, "__pii_digit")
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = docs.withColumns({body: t, digit: t.rlike("[0-9]")})
    b, d, none = F.col(body), F.col(digit), F.array().cast(MATCH)
    gates = {"email": b.contains("@"), "ip": d & b.contains("."), "card": d, "phone": d & b.contains("+")}
    found = marked.withColumns({base[k]: F.when(gates[k], spans_by(b, BASE[k])).otherwise(none) for k in KINDS})
    found = found.withColumns({wide[k]: F.when((d if k != "email" else F.lit(True)) & b.rlike(NEEDS[k]), spans_by(b, WIDE[k])).otherwise(none) for k in KINDS})

    nothing = [F.lit(None).cast("struct<" + ",".join(f"{f}:int" for f in fields) + ">") for fields in (LABELERS, FEATURES)]

    def both(k: str) -> Column:
        good = F.filter(base[k], lambda x: passes(k, x["match"]))
        own = F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(True).alias("base"), nothing[0].alias("votes"), nothing[1].alias("features")))
        apart = F.filter(wide[k], lambda w: ~F.exists(base[k], lambda x: (x["start"] < w["end"]) & (w["start"] < x["end"])))
        return F.when(F.size(wide[k]) > 0, F.concat(own, _labelled(k, apart))).otherwise(own)

    return found.withColumns({names[k]: both(k) for k in KINDS}).drop(*base.values(), *wide.values(), body, digit)


#: Candidates that each written example counts for.
SEED_WEIGHT = 25.0
#: Written examples and look-alikes: w a word, d a digit, e a digit from 2 on, b a byte, x a hex group, C a number with a right check digit.
EXAMPLES = {
    "email": ["w.w (at) w.com", "wd[at]w[dot]org", "w_w {at} w {dot} de", "w at w dot net", "w.w(AT)w(DOT)fr", "w-w [ at ] w [ dot ] io", "w (at) w-w.edu", "wdd at w dot w dot com"],
    "ip": ["b[.]b[.]b[.]b", "b(.)b(.)b(.)b", "b[dot]b[dot]b[dot]b", "b (dot) b (dot) b (dot) b", "2001:x:x:x:x:x:x:x", "2a02:x:x:x:x:x:x:x", "fe80:x:x:x:x:x:x:x"],
    "card": ["C/C/C/C", "C.C.C.C", "C - C - C - C", "C_C_C_C", "C  C  C  C"],
    "phone": ["(edd) edd-dddd", "edd-edd-dddd", "(edd) edd dddd", "edd edd dddd", "00e1 dd ddddddd", "00e4/dd/dddddd", "0edd/dddddd", "0edd/ddddddd", "01dd/dddddddd", "00ed dd dddd dddd"],
}
LOOKALIKES = {
    "email": ["w at w.w", "w at w.ww", "w at w-w.w", "ww at w.w.w"],
    "ip": ["7dd[.]8dd[.]9dd[.]3dd", "4dd(.)b(.)b(.)b", "b[.]b[.]b[.]999", "0db[.]b[.]0dd[.]b"],
    "card": ["9ddd/dddd/dddd/dddX", "1ddd.dddd.dddd.dddX", "0ddd - dddd - dddd - dddX", "7ddd_dddd_dddd_dX", "8ddd  dddd  dddd  dddX"],
    "phone": ["0dd.1dd.dddd", "1dd.0dd.dddd", "1dd-0dd-dddd", "1dd 1dd dddd", "0dd.0dd.dddd", "e11.0dd.dddd"],
}
LEADS = {True: ["", "see ", "(", "contact: ", "{cue} ", "{cue}: "], False: ["", "see ", "part ", "version ", "total ", "order "]}
TAILS = {True: ["", ".", ", thanks", " today", ")"], False: ["", ".", " then", " units", "/w", " beta"]}
SEED_CUES = {"email": "mail", "ip": "host", "card": "card", "phone": "call"}


def _written(form: str, r: random.Random) -> str:
    """One text of a form."""
    digit = lambda low=0: str(r.randrange(low, 10))
    if "C" in form:
        body = [int(c) for c in r.choice(["4", "51", "53", "55"])]
        body += [r.randrange(10) for _ in range(15 - len(body))]
        number = "".join(map(str, body)) + str(-sum(sum(divmod(n * (2 - i % 2), 10)) for i, n in enumerate(body)) % 10)
        groups = iter(number[i : i + 4] for i in range(0, 16, 4))
        return "".join(next(groups) if c == "C" else c for c in form)
    word = lambda: "".join(r.choice(["lo", "nar", "ke", "mi", "sto", "bu", "ha"]) for _ in range(r.randrange(1, 4)))
    made = {"w": word, "d": digit, "e": lambda: digit(2), "b": lambda: str(r.randrange(1, 255)), "x": lambda: f"{r.randrange(65536):x}", "X": digit}
    kept = re.split(r"(com|org|net|edu|fr|de|io|dot|at|AT|DOT|fe80|2a02)", form) if "w" in form or "b" in form or "x" in form else [form]
    return "".join(part if i % 2 else "".join(made[c]() if c in made else c for c in part) for i, part in enumerate(kept))


def seeds(each: int = 12, seed: int = 1) -> list[tuple[str, str, bool]]:
    """(text, kind, whether its candidate is personal data), the same on every run."""
    r, out = random.Random(seed), []
    for kind in KINDS:
        for forms, sure in ((EXAMPLES[kind], True), (LOOKALIKES[kind], False)):
            for i in range(each * max(len(EXAMPLES[kind]), len(LOOKALIKES[kind]))):
                lead, tail = r.choice(LEADS[sure]).replace("{cue}", SEED_CUES[kind]), r.choice(TAILS[sure]).replace("w", "lo")
                out.append((lead + _written(forms[i % len(forms)], r) + tail, kind, sure))
    return out


#: Votes and features of one written example, and whether it is personal data.
Seed = tuple[tuple[int, ...], tuple[int, ...], bool]


def seed_marks(spark: SparkSession) -> dict[str, list[Seed]]:
    """Votes and features of the written examples: a job over a few hundred fixed short texts."""
    docs = spark.createDataFrame(seeds(), "text string, kind string, sure boolean")
    names = {k: f"c_{k}" for k in KINDS}
    out: dict[str, list[Seed]] = {k: [] for k in KINDS}
    for r in candidates(docs, names).collect():
        for x in r[names[r["kind"]]]:
            if not x["base"]:
                out[r["kind"]].append((tuple(x["votes"]), tuple(x["features"]), r["sure"]))
    return out


def estimate(counts: dict[tuple[int, ...], float], known: list[Seed] = (), rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Probability that a span with a vote pattern is personal data, by
    expectation-maximisation over the labelers' confusion tables (two classes,
    three votes, abstaining is one).  It starts from the ``known`` examples, which stay in
    every round, or else from the majority of the votes."""
    fixed_size = [1.0, 1.0]
    fixed = [[defaultdict(lambda: 1.0) for _ in LABELERS] for _ in range(2)]
    for votes, _, sure in known:
        fixed_size[sure] += SEED_WEIGHT
        for labeler, x in enumerate(votes):
            fixed[sure][labeler][x] += SEED_WEIGHT

    def judged(size: list[float], table: list) -> dict[tuple[int, ...], float]:
        out = {}
        for v in counts:
            odds = math.log(size[1]) - math.log(size[0])
            for labeler, x in enumerate(v):
                odds += math.log(table[1][labeler][x] / (size[1] + 2)) - math.log(table[0][labeler][x] / (size[0] + 2))
            out[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        return out

    belief = judged(fixed_size, fixed) if known else {v: (sum(x > 0 for x in v) + 0.5) / (sum(x != 0 for x in v) + 1) for v in counts}
    for _ in range(rounds):
        size = list(fixed_size)
        table = [[t.copy() for t in side] for side in fixed]
        for v, n in counts.items():
            for y, p in ((1, belief[v]), (0, 1 - belief[v])):
                size[y] += n * p
                for labeler, x in enumerate(v):
                    table[y][labeler][x] += n * p
        belief = judged(size, table)
    return belief


def fit_classifier(rows: list[tuple[tuple[str, ...], float, float]], rounds: int = 400, rate: float = 1.0, ridge: float = 1e-4) -> dict[str, float]:
    """Logistic weights of named binary features from (features, probability, count)."""
    weight: dict[str, float] = defaultdict(float)
    total = sum(n for *_, n in rows) or 1.0
    for _ in range(rounds):
        slope: dict[str, float] = defaultdict(float)
        for names, target, n in rows:
            z = sum(weight[k] for k in names)
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - target
            for k in names:
                slope[k] += error * n / total
        for k, s in slope.items():
            weight[k] -= rate * (s + ridge * weight[k])
    return dict(weight)


class SpanClassifier:
    """Weights of features by kind, as a column expression."""

    def __init__(self, weights: dict[str, dict[str, float]], threshold: float = 0.9):
        self.weights, self.cut = weights, math.log(threshold / (1 - threshold))

    def accepts(self, kind: str, x: Column) -> Column:
        own = self.weights.get(kind)
        if not own:
            return F.lit(False)
        z = F.lit(own.get("bias", 0.0))
        for name, w in sorted(own.items()):
            feature, _, value = name.partition("=")
            if value:
                z = z + F.when(x["features"][feature] == int(value), w).otherwise(0.0)
        content = [x["votes"][v] for v in CONTENT]
        return F.coalesce(~x["base"] & (z > self.cut) & (sum(content[1:], content[0]) > 0), F.lit(False))


def train(found: DataFrame, names: dict[str, str], threshold: float = 0.9) -> SpanClassifier:
    """Estimate the labelers' reliabilities on all candidates of ``found`` and the written examples, and fit the classifier."""
    known = seed_marks(found.sparkSession)

    def tagged(kind: str) -> Column:
        return F.transform(F.filter(names[kind], lambda x: ~x["base"]), lambda x: F.struct(F.lit(kind).alias("kind"), x["votes"].alias("votes"), x["features"].alias("features")))

    each = F.flatten(F.array(*map(tagged, KINDS)))
    spans = found.select(F.explode(each).alias("x")).select("x.kind", *[F.col(f"x.votes.{v}") for v in LABELERS], *[F.col(f"x.features.{f}") for f in FEATURES])
    patterns = staged(spans.groupBy(*spans.columns).count(), "pii-patterns")
    voted: dict[str, dict[tuple[int, ...], float]] = {k: {} for k in KINDS}
    for r in patterns.groupBy("kind", *LABELERS).agg(F.sum("count").alias("n")).collect():
        voted[r["kind"]][tuple(r[v] for v in LABELERS)] = float(r["n"])
    belief = {k: estimate(v, known[k]) for k, v in voted.items()}
    told = [(F.lit("|".join(map(str, (k, *v)))), F.lit(p)) for k in KINDS for v, p in sorted(belief[k].items())]
    table = F.create_map(*[x for pair in told for x in pair]) if told else F.create_map().cast("map<string,double>")
    weighed = patterns.withColumn("p", F.element_at(table, F.concat_ws("|", "kind", *LABELERS)) * F.col("count"))
    named = lambda values: ("bias", *(f"{f}={v}" for f, v in zip(FEATURES, values, strict=True)))
    rows: dict[str, list] = {k: [(named(features), float(sure), SEED_WEIGHT) for _, features, sure in known[k]] for k in KINDS}
    for r in weighed.groupBy("kind", *FEATURES).agg(F.sum("count").alias("n"), F.sum("p").alias("p")).collect():
        rows[r["kind"]].append((named([r[f] for f in FEATURES]), r["p"] / r["n"], float(r["n"])))
    return SpanClassifier({k: fit_classifier(sorted(v)) for k, v in rows.items() if v}, threshold)


def personal_data(docs: DataFrame, text: str = "text", threshold: float = 0.9) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind number, end),
    sorted, of the base spans and of all spans; columns with these names are replaced."""
    docs = docs.drop("base", "spans")
    names = {k: free_name(docs, f"__pii_{k}") for k in KINDS}
    found = candidates(docs, names, text)
    with scratch(docs.sparkSession):
        classifier = train(found, names, threshold)

    strict = lambda x: x["base"]
    places = lambda k: F.transform(F.filter(names[k], strict), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    taken = free_name(docs, "__pii_taken")
    found = found.withColumn(taken, F.concat(*map(places, KINDS)))

    def chosen(k: int, kind: str, base: bool) -> Column:
        clear = lambda x: ~F.exists(taken, lambda t: (t["start"] < x["end"]) & (x["start"] < t["end"]))
        keep = F.filter(names[kind], strict if base else lambda x: strict(x) | classifier.accepts(kind, x) & clear(x))
        return F.transform(keep, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))

    both = {name: F.array_sort(F.concat(*[chosen(i, k, name == "base") for i, k in enumerate(KINDS)])) for name in ("base", "spans")}
    return found.withColumns(both).drop(*names.values(), taken)


def spans_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
