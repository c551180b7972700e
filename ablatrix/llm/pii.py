"""Personal data (operator 3): weak supervision with DataFrame and SQL functions only.

Candidates are spans found by patterns: the four base kinds (email, ip, card, phone), whose valid matches always stay, and
looser ones (local phone numbers, spelled-out addresses, social security numbers, titled names). Four labelers vote on each
candidate with 1, 0 (no opinion) or -1:
  shape      a stricter regex for the kind;
  gazetteer  lists of top-level domains, dialling codes, issuer numbers, reserved networks, given names;
  context    cue words between the span and the one of its kind before it, at most `WINDOW` characters away;
  check      check digits and admissible numbers.
Votes and two coarse features are counted over all documents; the table of counts has at most kinds x 3^4 x 12 rows whatever
the corpus. Expectation-maximisation on it estimates each labeler's reliabilities per kind and the posterior of each vote
pattern, and those posteriors train the final span classifier, a naive Bayes over gazetteer, context, length and what stands
before the span. Loose candidates with a probability of 1/2 or more join the base spans; those that overlap a base span don't.

Positions are code points, ends exclusive. A span's position comes from the lengths of the pieces between matches, so texts are
scanned whole, without a window, in time linear in text and matches. Patterns use possessive loops where nothing can be given back, which matches the same text
in linear time without recursion. Null texts count as empty; empty texts and empty tables give no spans; rows may repeat, each
is scanned alone; only doc_id and text are read, so further columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import empty_text, stored, table

WINDOW = 32
ROUNDS = 12
#: Values folded at once.
FOLD = 64
THRESHOLD = 0.5
BASE = ("email", "ip", "card", "phone")
LOOSE = ("local_phone", "spelled_email", "ssn", "name")
KINDS = BASE + LOOSE
LOCAL = r"[A-Za-z0-9._%+-]"
#: A match starts where the last one ended or where no character of its run stands before; all later starts in a run that
#: failed fail too. `{11,}`: runs of under 12 digits are dropped in any case.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+).-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "spelled_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{2,63}){1,4}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?",
}
#: What a text must hold before its pattern is tried.
NEEDS = {
    "email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
    "local_phone": r"[0-9][.-][0-9]{4}", "spelled_email": r"[\[(]at[\])]", "ssn": r"-[0-9]{2}-", "name": r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
CUES = {
    "email": "e-?mail|mail|contact|write|reach|kontakt|correo|courriel", "ip": r"\bip\b|address|host|server|from|login|adresse",
    "card": "card|visa|master|amex|credit|pay|karte|tarjeta|carte", "phone": "phone|call|tel|mobile|fax|dial|telefon|teléfono|téléphone",
    "local_phone": "phone|call|tel|mobile|fax|dial|telefon|teléfono|téléphone", "spelled_email": "e-?mail|mail|contact|write|reach",
    "ssn": "ssn|social|security|tax|id", "name": "contact|name|signed|dear|regards|by",
}
AGAINST = {
    "email": r"git|ssh|scp", "ip": r"version|\bv\.?\s*$|release|section|chapter|§", "card": r"isbn|order|invoice|serial|tracking|sku",
    "phone": r"isbn|version|order", "local_phone": r"isbn|version|order|part|sku", "spelled_email": "git", "ssn": r"part|sku|isbn|order|version", "name": r"street|avenue",
}
GAZETTEER = {
    "email": (r"\.(?:com|org|net|edu|gov|mil|int|info|io|de|fr|es|uk|us|ca|eu|ch|at|it|nl|pl|ru|jp|cn|br|in|au)$", r"\.(?:local|invalid|test|png|jpg|js|py)$"),
    "ip": (r"^(?!0|10\.|127\.|192\.168\.|22[4-9]\.|2[345][0-9]\.)", r"^(?:0\.|127\.|255\.255\.)"),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)", r"^(?:0|1|9)"),
    "phone": (r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", r"^\+0"),
    "local_phone": (r"^\(?[2-9][0-9]{2}", r"^\(?[01]"),
    "spelled_email": (r"(?:com|org|net|edu|gov|io|de|fr|es|uk)$", r"(?:png|jpg|js|py)$"),
    "ssn": (r"^(?!000|666|9)", r"^(?:000|666|9)"),
    "name": (r"\x20(?:John|Mary|James|Anna|Peter|Paul|Maria|Hans|Jean|Pierre|Juan|Ana|David|Laura|Thomas|Sarah)\b", r"^(?!)"),
}
SHAPE = {
    "email": r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$", "card": r"^(?:[0-9]{13,19}|(?:[0-9]{4}[\x20-]){3}[0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,4}$", "local_phone": r"^(?:\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})$",
    "spelled_email": r"[\[(]dot[\])]", "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "name": r"^\w+\.?\x20[A-Z][a-z]+\x20[A-Z][a-z]+$",
}
LABELERS = ("shape", "gazetteer", "context", "check")


def _let(value: Column, body) -> Column:
    """body of value, which is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before_each(values: Column, op, zero: Column) -> Column:
    """For each of an array's values, op over all values before it (zero for the first). op is associative.

    Arrays grow by copying, so values are folded in chunks of `FOLD`, then the chunks' results: about FOLD / 2 copies a value."""
    grow = lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))

    def chunked(v):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / FOLD).cast("int")), lambda i: F.slice(v, i * FOLD + 1, F.lit(FOLD)))
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.array(zero), grow))

        def joined(r):
            starts = F.aggregate(r, F.array(zero), lambda acc, x: grow(acc, F.element_at(x, -1)))
            return F.flatten(F.zip_with(r, F.slice(starts, F.lit(1), F.size(r)), lambda x, s: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda e: op(s, e))))

        return _let(sums, joined)

    return _let(values, lambda v: F.when(F.size(v) > 0, chunked(v)).otherwise(F.slice(v, 1, 0)))


def _found(text: Column, kind: str) -> Column:
    """All matches as array<struct<start, end, match, before>>: starts are running sums over pieces between matches and matches;
    before is what stands before the match and after the last one, at most `WINDOW` characters of it."""
    pattern = PATTERNS[kind]
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    whole = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))

    def place(x, at):
        start = at + F.length(x["gap"])
        return F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match"), F.right(x["gap"], F.lit(WINDOW)).alias("before"))

    places = lambda p: F.zip_with(p, _before_each(F.transform(p, whole), lambda a, b: a + b, F.lit(0)), place)
    spans = F.filter(_let(pairs, places), lambda s: s["match"].isNotNull())
    return F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,match:string,before:string>>)"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    """What a match of a base kind must satisfy to count."""
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _votes(kind: str, match: Column, before: Column) -> list[Column]:
    n = F.length(_digits(match))
    checks = {
        "email": (F.length(match) <= 254, F.length(match) > 254), "ip": (match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), F.lit(False)),
        "card": (F.call_function("luhn_check", _digits(match)), F.lit(False)), "phone": (n.between(10, 14), n == 9),
        "local_phone": (match.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9]"), match.rlike(r"^\(?[01]")), "spelled_email": (F.length(match) <= 128, F.length(match) > 200),
        "ssn": (~match.rlike(r"-00-|-0000$"), match.rlike(r"-00-|-0000$")), "name": (F.lit(False), F.length(match) > 40),
    }
    shape = match.rlike(SHAPE[kind])
    return [_vote(shape, ~shape), _vote(match.rlike(GAZETTEER[kind][0]), match.rlike(GAZETTEER[kind][1])), _vote(before.rlike(CUES[kind]), before.rlike(AGAINST[kind])), _vote(*checks[kind])]


def _candidates(text: Column, kind: str) -> Column:
    """array<struct<start, kind, end, base, pattern>>; pattern: kind, votes, length class and what stands before."""

    def describe(s):
        before = F.lower(s["before"])
        votes = F.concat(*[F.element_at(F.array(*map(F.lit, "-0+")), v + 2) for v in _votes(kind, s["match"], before)])
        length = F.when(F.length(s["match"]) < 12, "a").when(F.length(s["match"]) < 16, "b").when(F.length(s["match"]) < 24, "c").otherwise("d")
        edge = F.when(before == "", "s").when(before.rlike(r"\s$"), "w").otherwise("x")
        return F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), F.lit(kind in BASE).alias("base"),
            F.concat(F.lit(str(KINDS.index(kind))), votes, length, edge).alias("pattern"),
        )

    return F.transform(F.filter(_found(text, kind), lambda s: _valid(kind, s["match"])), describe)


def candidates(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """docs with a column `pii_candidates`, sorted by start, then kind."""
    text = empty_text() if text is None else text
    base = F.concat(*[_candidates(text, k) for k in BASE])
    loose = F.concat(*[_candidates(text, k) for k in LOOSE])
    docs = docs.withColumns({"_pii_base": F.array_sort(base), "_pii_loose": loose})

    def apart(every):
        """every: all candidates by start. Loose ones stay if no base one before ends, and none after starts, within them."""
        far = F.lit((1 << 31) - 1)
        ends = _before_each(F.transform(every, lambda s: F.when(s["base"], s["end"]).otherwise(F.lit(0))), F.greatest, F.lit(0))
        starts = F.reverse(_before_each(F.reverse(F.transform(every, lambda s: F.when(s["base"], s["start"]).otherwise(far))), F.least, far))
        room = F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        free = lambda s, r: s["base"] | ((r["a"] <= s["start"]) & (r["b"] >= s["end"]))
        marked = F.zip_with(every, room, lambda s, r: F.when(free(s, r), s))
        return F.filter(marked, lambda s: s.isNotNull())

    both = _let(F.array_sort(F.concat("_pii_base", "_pii_loose")), apart)
    return docs.withColumn("pii_candidates", F.when(F.size("_pii_loose") == 0, F.col("_pii_base")).otherwise(both)).drop("_pii_base", "_pii_loose")


def accepted_patterns(counts: list[tuple[str, int]]) -> dict[str, float]:
    """Probability of each pattern. counts: (pattern, number of candidates) over the corpus, a table of bounded size.

    Per kind, EM over vote patterns with one confusion table per labeler, then the naive Bayes trained on its posteriors."""
    out: dict[str, float] = {}
    for kind in {p[0] for p, _ in counts}:
        rows = [(p[1:5], p[5:], n) for p, n in counts if p[0] == kind]
        post = {v: 1 / (1 + math.exp(-(v.count("+") - v.count("-")))) for v, _, _ in rows}
        for _ in range(ROUNDS):
            sums = {y: [dict.fromkeys("-0+", 0.5) for _ in LABELERS] for y in (0, 1)}
            mass = [0.5, 0.5]
            for votes, _, n in rows:
                for y, q in ((1, post[votes]), (0, 1 - post[votes])):
                    mass[y] += n * q
                    for k, v in enumerate(votes):
                        sums[y][k][v] += n * q
            # a labeler is never worse than chance: without this the two classes could change names
            like = {y: [{v: c / sum(t.values()) for v, c in t.items()} for t in sums[y]] for y in (0, 1)}
            for k in range(len(LABELERS)):
                if like[1][k]["+"] < like[0][k]["+"] and like[1][k]["-"] > like[0][k]["-"]:
                    like[1][k] = like[0][k] = {v: (like[1][k][v] + like[0][k][v]) / 2 for v in "-0+"}
            for votes in post:
                odds = math.log(mass[1] / mass[0]) + sum(math.log(like[1][k][v] / like[0][k][v]) for k, v in enumerate(votes))
                post[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        features = [dict(), dict()]
        mass = [1.0, 1.0]
        view = lambda v, f: ((0, v[1]), (1, v[2]), (2, f[0]), (3, f[1]))
        for votes, feats, n in rows:
            for y, q in ((1, post[votes]), (0, 1 - post[votes])):
                mass[y] += n * q
                for x in view(votes, feats):
                    features[y][x] = features[y].get(x, 0.5) + n * q
        for votes, feats, _ in rows:
            odds = math.log(mass[1] / mass[0]) + sum(math.log(features[1].get(x, 0.5) / mass[1] / (features[0].get(x, 0.5) / mass[0])) for x in view(votes, feats))
            out[kind + votes + feats] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return out


def pattern_probabilities(found: DataFrame) -> dict[str, float]:
    """found: rows with pii_candidates. The counts are collected: at most kinds x 81 x 12 rows, however large the corpus."""
    counts = found.select(F.explode("pii_candidates.pattern").alias("pattern")).groupBy("pattern").count()
    return accepted_patterns(sorted((r["pattern"], r["count"]) for r in counts.collect()))


def _kept(probabilities: dict[str, float]) -> Column:
    good = [p for p, q in sorted(probabilities.items()) if q >= THRESHOLD and KINDS[int(p[0])] in LOOSE]
    accepted = F.array(*map(F.lit, good)) if good else F.expr("cast(array() as array<string>)")
    return F.filter("pii_candidates", lambda s: s["base"] | F.array_contains(accepted, s["pattern"]))


def detect_pii(docs: DataFrame) -> DataFrame:
    """doc_id, pii array<struct<start, kind (ordinal in KINDS), end, base, pattern>> for every row."""
    found = stored(candidates(docs.select("doc_id", "text")).select("doc_id", "pii_candidates"), "pii")
    return found.select("doc_id", _kept(pattern_probabilities(found)).alias("pii"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; overlapping spans become one, named after the first."""
    found = stored(candidates(docs), "pii-docs")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")

    def cuts(spans):
        """What goes: (from, to) is the text kept before it."""
        reach = _before_each(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))
        cut = F.zip_with(spans, reach, lambda s, r: F.when(s["start"] >= r, F.struct(r.alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))))
        return F.filter(cut, lambda c: c.isNotNull())

    def joined(piece, c):
        return F.array_join(F.transform(c, lambda x: F.concat(piece(x["from"], x["to"] - x["from"]), F.element_at(names, x["kind"] + 1))), "")

    few = lambda c: joined(lambda a, n: F.substring(text, a + 1, n), c)
    many = lambda c: _let(F.split(text, ""), lambda chars: joined(lambda a, n: F.array_join(F.slice(chars, a + 1, n), ""), c))
    head = _let(cuts(F.col("_pii")), lambda c: F.when(F.size(c) <= FOLD, few(c)).otherwise(many(c)))
    tail = F.substring(text, F.array_max(F.transform("_pii", lambda s: s["end"])) + 1, F.length(text))
    found = found.withColumn("_pii", _kept(pattern_probabilities(found)))
    clean = F.when(F.size("_pii") > 0, F.concat(head, tail)).otherwise(text)
    return found.select(*[clean.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: the contract's digest of detect_pii()."""
    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda i: F.size(F.filter("pii", lambda s: s["kind"] == i)).cast("long")
    return detect_pii(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(joined(F.filter("pii", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )
