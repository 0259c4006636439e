r"""Personal data by weak supervision, in DataFrame functions throughout.

Base spans follow fixed rules (BASE) and always stay. Candidates are the base rules' matches, valid or not, and looser ones (LOOSE): telephone
numbers without a plus sign, and long mixed tokens that may be secrets. Four labelers vote 1, 0 or -1 on each candidate: a strict
pattern, a gazetteer (top-level domains, country codes, card issuers, key prefixes), the words just before, and the shape of the digits.

Expectation-maximisation over the table of vote patterns (one row for each kind and pattern, so its size is fixed by the labelers)
estimates how reliable each labeler is for each kind. Its posteriors are soft labels of a span classifier, naive Bayes on discrete span features, whose
counts Spark sums. Loose candidates with probability one half or more that touch no base span are added; what a fixed rule matched and found invalid stays out.

Offsets are code points, ends exclusive. Rules are written with possessive repeats and anchors, which match what the plain rules match, in
time linear in the text. Places of matches are summed up in two steps, so that a text of n matches takes some n * sqrt(n) additions.

Cases: a null text counts as empty; texts without matches have no spans; without any candidates the classifier adds nothing; null and
repeated doc_ids each have their row; an empty table gives an empty result; columns that aren't asked for aren't read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone", "secret")
# Fixed rules. Plain forms:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
#   card  [0-9]([\x20-]?[0-9])+, 16 to 19 digits, Luhn           phone \+[0-9][\x20().0-9-]+[0-9], 8 to 15 digits
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",  # those that hold a digit
}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}$",
    "ip": rf"^{OCTET}(?:\.{OCTET}){{3}}$",
    "card": r"^(?:[0-9]{4}[ -]?){3}[0-9]{4,7}$|^[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}$",
    "secret": r"^AKIA[0-9A-Z]{16}$|^[0-9a-f]{16,}$|^gh[pousr]_[A-Za-z0-9]{30,}$",
}
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|co|us|it|nl|ch|at)$",
    "ip": r"^(?!0|127\.|255\.|22[4-9]\.|2[34][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}",
    "secret": r"^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|AIza)",
}
CONTEXT = {
    "email": r"(?:e-?mail|mail|contact|write to|correo|courriel)\W*$",
    "ip": r"(?:\bip\b|host|server|address|adresse)\W*$",
    "card": r"(?:card|visa|credit|karte|tarjeta|carte)\W*$",
    "phone": r"(?:phone|tel|call|fax|mobile|telefon|telefono|téléphone)\W*$",
    "secret": r"(?:password|passwd|pwd|secret|token|api.?key|credential)s?\s*[=:]?\s*[\"']?$",
}
BEFORE = 24
CHUNK = 1024
VOTERS = ("strict", "gazetteer", "context", "shape")
FEATURES = ("length", "digits", "left", "right")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once; a plain Column used inside a lambda is computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(x: Column) -> Column:
    return F.length(x).cast("long")


def matches(text: Column, rule: str, worth: Callable[[Column], Column] = lambda found: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches that are worth a look: start, end, text, before (up to BEFORE characters, lower case, that reach back over one match at most) and after (a character).

    Between matches lie the parts that splitting by the rule leaves, so places are sums of lengths: inside runs of about sqrt(n) matches, and over the runs."""

    def looked_at(m: Column) -> Column:
        """Runs of matches: text, gap (the length of the part before), before and after."""

        def run(k: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                at = k * m["step"] + i
                last = F.when(at > 0, F.right(F.get(m["found"], at - 1), F.lit(BEFORE))).otherwise("")
                before = F.lower(F.right(F.concat(last, F.right(F.get(m["gaps"], at), F.lit(BEFORE))), F.lit(BEFORE)))
                after = F.substring(F.concat(F.get(m["gaps"], at + 1), F.coalesce(F.get(m["found"], at + 1), F.lit(""))), 1, 1)
                return F.struct(x.alias("text"), _long(F.get(m["gaps"], at)).alias("gap"), F.when(worth(x), F.struct(before.alias("before"), after.alias("after"))).alias("sides"))

            return F.transform(F.slice(m["found"], k * m["step"] + 1, m["step"]), one)

        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(m["found"]) / m["step"]).cast("int") - 1), run)

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + x["gap"] + _long(x["text"]))

    def placed(runs: Column) -> Column:
        def inside(sums: Column) -> Column:
            def run(part: Column, k: Column) -> Column:
                from_ = F.aggregate(F.slice(sums, 1, k), F.lit(0).cast("long"), lambda acc, x: acc + x)

                def one(base: Column):
                    def at(x: Column, i: Column) -> Column:
                        start = base + total(F.slice(part, 1, i)) + x["gap"]
                        return F.when(x["sides"].isNotNull(), F.struct(start.alias("start"), (start + _long(x["text"])).alias("end"), x["text"].alias("text"), x["sides"]["before"].alias("before"), x["sides"]["after"].alias("after")))

                    return F.filter(F.transform(part, at), lambda x: x.isNotNull())

                return let(from_, one)

            return F.flatten(F.transform(runs, run))

        return let(F.transform(runs, total), inside)

    found = F.struct(F.regexp_extract_all(text, F.lit(rule), F.lit(0)).alias("found"), F.split(text, rule, -1).alias("gaps"))
    steps = lambda m: F.struct(m["found"].alias("found"), m["gaps"].alias("gaps"), F.ceil(F.sqrt(F.size(m["found"]))).cast("int").alias("step"))
    every = lambda m: let(steps(m), lambda q: let(looked_at(q), placed))
    return let(found, lambda m: F.when(F.size(m["found"]) > 0, every(m)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(STRICT["ip"])
    if kind == "card":
        d = _digits(text)
        return F.length(d).between(16, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    return (vote.when(no, -1) if no is not None else vote).otherwise(0)


def _candidate(kind: str, base: bool, m: Column) -> Column:
    t, before, after = m["text"], m["before"], m["after"]
    d, n = F.length(_digits(t)), F.length(t)
    strict = t.rlike(STRICT[kind]) & valid(kind, t)
    mixed = {"email": n.between(6, 64), "ip": n.between(7, 15), "card": d.between(15, 19), "phone": d.between(9, 13), "secret": (d >= 4) & (n - d >= 2)}[kind]
    side = lambda c: F.when(c == "", "edge").when(c.rlike(r"^[\s\"'(<=:,.;)>]$"), "mark").when(c.rlike("^[0-9]$"), "digit").otherwise("other")
    return F.struct(
        F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), (F.lit(base) & valid(kind, t)).alias("base"), F.lit(base).alias("fixed"),
        _vote(strict, ~strict).alias("strict"), _vote(t.rlike(GAZETTEER[kind]), F.lit(kind in ("email", "card"))).alias("gazetteer"),
        _vote(before.rlike(CONTEXT[kind])).alias("context"), _vote(mixed, ~mixed).alias("shape"),
        F.least(F.floor(n / 4), F.lit(16)).cast("string").alias("length"), F.floor(F.lit(8) * d / F.greatest(n, F.lit(1))).cast("string").alias("digits"),
        side(F.substring(before, -1, 1)).alias("left"), side(after).alias("right"),
    )


def _maker(kind: str, base: bool):
    return lambda m: _candidate(kind, base, m)


#: A number is a candidate for a card from this length on: shorter ones are neither base spans nor alike to any.
CARD_CHARS = 12


def candidates(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns of keep, and found: all candidates of the text, by kind and place. One pass over the texts."""
    text = F.col("_text")
    rows = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("_text"))
    # A text without the sign that a rule needs isn't searched by it.
    needs = {"email": text.contains("@"), "phone": text.contains("+")}
    digit = text.rlike("[0-9]")
    worth = {"card": lambda x: F.length(x) >= CARD_CHARS, "secret": lambda x: x.rlike("[0-9]")}
    lists = []
    for kind, rule, base in [*((k, r, True) for k, r in BASE.items()), *((k, r, False) for k, r in LOOSE.items())]:
        need = needs[kind] if base and kind in needs else digit
        lists.append(F.when(need, F.transform(matches(text, rule, *([worth[kind]] if kind in worth else [])), _maker(kind, base))))
    none = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), *(F.lit("").alias(c) for c in ("text", "before", "after")))
    empty = F.slice(F.array(_candidate("ip", False, none)), 1, 0)
    return rows.select("doc_id", *keep, F.concat(*(F.coalesce(x, empty) for x in lists)).alias("found"))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior of each (kind, votes) pattern by expectation-maximisation; patterns: with their counts.

    Reliabilities start from the belief that votes are right four times in five, and stay within bounds, so that a labeler that nobody contradicts isn't beyond doubt."""
    out: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = [(v, n) for k, v, n in patterns if k == kind]
        total = sum(n for _, n in rows)
        prior = 0.5
        table = [{y: {1: 0.4 if y else 0.1, -1: 0.1 if y else 0.4, 0: 0.5} for y in (0, 1)} for _ in VOTERS]
        post = [0.5] * len(rows)
        for _ in range(rounds):
            for i, (votes, _) in enumerate(rows):
                z = math.log(prior / (1 - prior)) + sum(math.log(table[j][1][v] / table[j][0][v]) for j, v in enumerate(votes))
                post[i] = 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
            mass = sum(p * n for p, (_, n) in zip(post, rows))
            prior = min(0.99, max(0.01, (mass + 1) / (total + 2)))
            for j in range(len(VOTERS)):
                for y in (0, 1):
                    sums = {v: 2.0 * (0.4 if (v == 1) == bool(y) and v else 0.1 if v else 0.5) for v in (-1, 0, 1)}
                    for p, (votes, n) in zip(post, rows):
                        sums[votes[j]] += n * (p if y else 1 - p)
                    whole = sum(sums.values())
                    table[j][y] = {v: max(0.01, s / whole) for v, s in sums.items()}
        out |= {(kind, votes): p for p, (votes, _) in zip(post, rows)}
    return out


def fit(found: DataFrame) -> dict[str, float]:
    """Log odds of the span classifier by "kind|feature|value", and by "kind|" its prior. What comes to the driver is a table of vote patterns and features: its size depends on the rules, not on the rows."""
    spans = found.select(F.explode("found").alias("s")).select("s.*")
    counts = spans.groupBy("kind", *VOTERS, *FEATURES).agg(F.count("*").alias("n")).collect()
    votes: dict = defaultdict(int)
    for r in counts:
        votes[r["kind"], tuple(r[v] for v in VOTERS)] += r["n"]
    posterior = estimate([(k, v, n) for (k, v), n in votes.items()])
    sums: dict = defaultdict(lambda: [0.0, 0.0])
    for r in counts:
        p = posterior[r["kind"], tuple(r[v] for v in VOTERS)]
        for key in (f"{r['kind']}|", *(f"{r['kind']}|{f}|{r[f]}" for f in (*FEATURES, *VOTERS))):
            sums[key][0] += (1 - p) * r["n"]
            sums[key][1] += p * r["n"]
    out = {}
    for key, (no, yes) in sums.items():
        kind = key.split("|")[0]
        no0, yes0 = sums[f"{kind}|"]
        out[key] = math.log((yes0 + 1) / (no0 + 1)) if key == f"{kind}|" else math.log((yes + 1) / (yes0 + 4) * (no0 + 4) / (no + 1))
    return out


def _below(spans: Column, place: Column) -> Column:
    """How many of the spans (ascending) start before a place: a binary search."""
    def step(at: Column, width: Column) -> Column:
        return F.when((at + width <= F.size(spans)) & (F.get(spans, at + width - 1)["start"] < place), at + width).otherwise(at)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(31)))), F.lit(0), step)


def decide(found: Column, model: dict[str, float]) -> Column:
    """The spans that stay, by kind and place: base ones, and candidates that the classifier accepts and that touch no base span."""
    base = F.filter(found, lambda s: s["base"])
    if not model:
        chosen = base
    else:
        odds = F.create_map(*(F.lit(x) for pair in sorted(model.items()) for x in pair))
        weigh = lambda key: F.coalesce(F.element_at(odds, key), F.lit(0.0))

        def accepted(s: Column) -> Column:
            z = weigh(F.concat(s["kind"], F.lit("|")))
            for f in (*FEATURES, *VOTERS):
                z = z + weigh(F.concat(s["kind"], F.lit(f"|{f}|"), s[f].cast("string")))
            return z >= 0

        def touched(s: Column, own: Column) -> Column:
            """Base spans of one kind are in order and apart, so the last one that starts before the end is the one that may touch."""
            return let(_below(own, s["end"]), lambda n: F.when(n > 0, F.get(own, n - 1)["end"] > s["start"]).otherwise(False))

        def with_more(kinds: Column) -> Column:
            apart = lambda s: ~reduce(lambda x, y: x | y, (touched(s, kinds[k]) for k in BASE))
            return F.filter(F.filter(found, lambda s: ~s["fixed"] & accepted(s)), apart)

        each = F.struct(*(base_of(found, k).alias(k) for k in BASE))
        # Most texts have no loose candidate, and need no search.
        chosen = F.when(F.exists(found, lambda s: ~s["fixed"]), F.concat(base, let(each, with_more))).otherwise(base)
    place = F.transform(chosen, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))
    return F.array_sort(place)


def detect(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns of keep, and spans (k, start, end, kind, base) of every whole text."""
    found = materialise(candidates(docs, keep), "pii")
    return found.select("doc_id", *keep, decide(F.col("found"), fit(found)).alias("spans"))


def base_of(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: (s["kind"] == kind) & s["base"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _between(chunks: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text that is cut into chunks."""
    i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
    head, tail = F.coalesce(F.get(chunks, i), F.lit("")), F.coalesce(F.get(chunks, j), F.lit(""))
    within = lambda x, start, n: F.substring(x, start.cast("int") + 1, n.cast("int"))
    over = F.concat(within(head, a % CHUNK, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), within(tail, F.lit(0), b % CHUNK))
    return F.when(b <= a, "").when(i == j, within(head, a % CHUNK, b - a)).otherwise(over)


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with each span of the text replaced by its kind in angle brackets; of spans that overlap the first stands for all. A null text stays null.

    A long text is cut into chunks, so that taking a part of it doesn't go through all that stands before, and spans are gone through in runs, each of which adds one string."""
    names = docs.columns
    rest = [c for c in names if c not in ("doc_id", "text")]
    packed = F.struct(F.lit(0).alias("none"), *rest).alias("pii_row")  # so that no name clashes with ours
    rows = detect(docs.select("doc_id", "text", packed), ["text", "pii_row"])
    begin = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def redacted(t: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            fresh = F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.array(_between(t["chunks"], acc["pos"], s["start"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("out"))
            return F.when(s["start"] >= acc["pos"], fresh).otherwise(F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out")))

        def run(acc: Column, k: Column) -> Column:
            own = F.aggregate(F.slice(t["spans"], k * t["step"] + 1, t["step"]), F.struct(acc["pos"].alias("pos"), F.array().cast("array<string>").alias("out")), step)
            return let(own, lambda o: F.struct(o["pos"].alias("pos"), F.concat(acc["out"], F.array(F.array_join(o["out"], ""))).alias("out")))

        runs = F.sequence(F.lit(0), F.ceil(F.size(t["spans"]) / t["step"]).cast("int") - 1)
        return F.aggregate(runs, begin, run, lambda acc: F.concat(F.array_join(acc["out"], ""), _between(t["chunks"], acc["pos"], _long(F.col("text")))))

    parts = F.struct(by_place.alias("spans"), F.ceil(F.sqrt(F.size("spans"))).cast("int").alias("step"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(let(parts, redacted))
    return rows.select(*(text.alias(c) if c == "text" else c if c == "doc_id" else F.col("pii_row")[c].alias(c) for c in names))
