"""Personal data by weak supervision: labelers vote on candidate spans, EM rates them, a classifier decides.

Everything runs as DataFrame and SQL functions; only vote counts (a table whose size the labelers fix) and
the fitted numbers reach the driver.

1. *Base spans.* One pattern per kind (email, ip, card, phone), leftmost and non-overlapping; matches that fail
   the kind's check (parts up to 255, 12 to 19 digits with a Luhn sum, 9 to 15 digits) are dropped without
   another try. Base spans are always reported.
2. *Candidates.* Narrower patterns find spans that the base patterns swallow or miss: phone numbers in
   national groups, cards in groups of four, addresses spelled with "at" and "dot", IPv6 addresses.
3. *Votes.* Five labelers say yes (1), no (-1) or nothing (0) of every base span and candidate: the strict
   form, a gazetteer (country codes, issuers, top-level domains, reserved networks), the words before
   (for and against), the signs on both sides, and the spelling (one separator throughout).
4. *Reliabilities.* Per kind, expectation-maximisation over the counts of vote patterns gives each labeler's
   rates among true and false spans, and each pattern's posterior.
5. *Classifier.* Ridge logistic regression on votes, kind and shape is trained on the posteriors (all spans,
   as weighted counts). A candidate is added when its probability is 0.5 or more and it touches no base span.

Positions are code points. They come from the lengths between matches, summed by a window per document, so
the work is linear in the matches. Patterns are possessive and start only where a run of their characters
starts, so that long words don't make them quadratic.

Defined cases: null and empty texts have no span; rows with equal doc_id and text are answered alike; null
doc_ids are answered by their text; ties in start are listed in the kinds' order; without any span nothing is
fitted; empty tables give an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockflow.llm.frames import stored

KINDS = ("email", "ip", "card", "phone")
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_AT, _DOT = r"(?: ?@ ?| ?\(at\) ?| ?\[at\] ?| at )", r"(?: ?\(dot\) ?| ?\[dot\] ?| dot )"

#: kind: (what a text must hold for the pattern to be tried, pattern)
BASE = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[ -]?[0-9]){11}", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
CANDIDATE = {
    "email": (r"(?i)dot", rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])"),
    "ip": (r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])"),
    "card": (r"[0-9]{4}[ .-]?[0-9]{4}[ .-]?[0-9]{4}", r"(?<![0-9A-Za-z])(?:3[47][0-9]{2}([ .-]?)[0-9]{6}\1[0-9]{5}|[0-9]{4}([ .-]?)[0-9]{4}\2[0-9]{4}\2[0-9]{1,4})(?![0-9A-Za-z])"),
    "phone": (r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
}
BEFORE, AFTER = 32, 2          # characters of context that the labelers see
LONGEST = 254                  # characters of a span that they look into

#: fixed values: words that speak for and against a kind when they stand before a span
WORDS_FOR = {"email": "e-?mail|mail|contact|write|reach|address", "ip": "ip|host|server|login|from|address",
             "card": "card|visa|mastercard|amex|credit|payment|pay", "phone": "phone|call|tel|mobile|cell|fax|whatsapp|contact"}
WORDS_AGAINST = "version|ver|isbn|issn|order|invoice|sku|serial|section|chapter|page|figure|build|release|v"
#: fixed values: top-level domains, country calling codes
TOP_LEVEL = ("com org net edu gov io co info biz dev app ai me de fr es it nl be ch at uk ie se no dk fi pl pt br mx ar "
             "us ca au nz in jp cn kr ru eu example").split()
CALLING = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420".split()
LABELERS = ("form", "gazetteer", "words", "edges", "spelling")
ROUNDS, SMOOTH = 30, 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def checked(kind: Column, m: Column) -> Column:
    """The kind's own check of a match."""
    digits = _digits(m)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    n = F.length(digits)
    return (F.when(kind == "email", True)
            .when(kind == "ip", m.contains(":") | m.rlike(rf"\A{part}(?:\.{part}){{3}}\z"))
            .when(kind == "card", F.when(n.between(12, 19), luhn(digits)).otherwise(False))
            .otherwise(n.between(9, 15)))


def _matches(kind: str, base: bool, text: Column) -> Column:
    """Array of (kind, base, i, gap, m, before, after): the matches of one pattern and the text lengths between them."""
    need, pattern = (BASE if base else CANDIDATE)[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    one = F.transform(found, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("i"), F.length(F.get(pieces, i)).cast("long").alias("gap"), m.alias("m"),
        F.right(F.get(pieces, i), F.lit(BEFORE)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(AFTER)).alias("after")))
    return F.when(text.rlike(need), one)


def _votes() -> dict[str, Column]:
    """The labelers; a span of more than ``LONGEST`` characters is no one's form, and no pattern runs over it."""
    kind, before, after = F.col("kind"), F.col("before"), F.col("after")
    m = F.when(F.length("m") <= LONGEST, F.col("m")).otherwise(F.lit(""))
    digits = _digits(m)

    def by(cases: dict[str, Column]) -> Column:
        out = F.lit(0)
        for k, v in cases.items():
            out = F.when(kind == k, v).otherwise(out)
        return out

    def yes(c: Column) -> Column:
        return F.when(c, 1).otherwise(-1)

    def maybe(c: Column) -> Column:
        return F.when(c, 1).otherwise(0)
    form = by({
        "email": yes(m.rlike(rf"(?i)\A[A-Z0-9](?:[A-Z0-9_%+-]|\.(?!\.))*(?:@|{_AT})[A-Z0-9](?:[A-Z0-9-]|\.(?!\.|\z)|{_DOT})*[A-Z]{{2,24}}\z")),
        "ip": yes(m.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z") | m.rlike(r"\A(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\z")),
        "card": yes(digits.rlike(r"\A(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6[0-9]{15})\z")),
        "phone": yes(m.rlike(r"\A(?:\+[0-9]{1,3}[ .-]?)?\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}\z"))})
    last = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)\z", 1))
    code = F.regexp_extract(m, r"\A\+([0-9]{1,3})(?![0-9])", 1)
    gazetteer = by({
        "email": maybe(last.isin(TOP_LEVEL)),
        "ip": F.when(m.rlike(r"\A(?:0|255)\."), -1).otherwise(maybe(~m.rlike(r"\A(?:127\.|169\.254\.|22[4-9]\.|2[3-5][0-9]\.)"))),
        "card": F.when(digits.rlike(r"\A([0-9])\1*\z"), -1).otherwise(maybe(digits.rlike(r"\A(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|6)"))),
        "phone": F.when(code == "", 0).otherwise(yes(code.isin(CALLING)))})
    said = by({k: F.when(before.rlike(rf"(?i)\b(?:{w})\b[^A-Za-z0-9]{{0,4}}(?:[a-z]{{1,8}} ?){{0,2}}[:=#]?\s*\z"), 1) for k, w in WORDS_FOR.items()})
    words = F.when(said == 1, 1).when(before.rlike(rf"(?i)\b(?:{WORDS_AGAINST})\b\.?\s?[:=#]?\s*\z"), -1).otherwise(0)
    left = before.rlike(r"(?:\A|[\s(\[<\"':,;])\z")
    right = after.rlike(r"\A(?:\z|[\s)\]>\"',;:!?]|\.(?:\s|\z))")
    return {"form": form, "gazetteer": gazetteer, "words": words,
            "edges": F.when(left & right, 1).when(before.rlike(r"[A-Za-z0-9_=/#$€]\z") | after.rlike(r"\A[A-Za-z0-9_=/%]"), -1).otherwise(0),
            "spelling": F.when(m.rlike(r"[ .-]{2}|\.\z|-\z"), -1).otherwise(maybe(~(m.contains(" ") & m.contains(".") & (kind != "email"))))}


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[list[float], list[list[dict[int, float]]], float]:
    """EM over vote patterns with counts: (posterior of each pattern, rates[labeler][truth][vote], share of true spans).

    It starts from the votes' sum, so a labeler counts for more or less only by its agreement with the others."""
    q = [1 / (1 + np.exp(-sum(v))) for v, _ in patterns]
    n = len(patterns[0][0])
    total = sum(c for _, c in patterns)
    rates, share = [], 0.5
    for _ in range(rounds):
        share = min(max(sum(c * p for (_, c), p in zip(patterns, q)) / total, 0.01), 0.99)
        rates = []
        for j in range(n):
            both = []
            for truth in (0, 1):
                s = {v: SMOOTH for v in (-1, 0, 1)}
                for (votes, c), p in zip(patterns, q):
                    s[votes[j]] += c * (p if truth else 1 - p)
                both.append({v: x / sum(s.values()) for v, x in s.items()})
            rates.append(both)
        odds = [np.log(share / (1 - share)) + sum(np.log(rates[j][1][v] / rates[j][0][v]) for j, v in enumerate(votes)) for votes, _ in patterns]
        q = [float(1 / (1 + np.exp(-np.clip(o, -30, 30)))) for o in odds]
    return q, rates, share


def _features() -> dict[str, Column]:
    """What the classifier sees: each labeler's yes and no, the kind, and the shape of the span."""
    out = {}
    for j in LABELERS:
        out[f"{j}_yes"], out[f"{j}_no"] = F.col(j) == 1, F.col(j) == -1
    for k in KINDS:
        out[f"is_{k}"] = F.col("kind") == k
    return out | {"separated": F.col("separated"), "marked": F.col("marked")}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def span_model(spans: DataFrame) -> Column:
    """Probability of a span, fitted on all spans (counts by kind, votes and shape: at most 4 * 3**5 * 4 rows)."""
    rows = spans.groupBy("kind", *LABELERS, "separated", "marked").count().collect()
    if not rows:
        return F.lit(0.0)
    truth: dict[int, float] = {}
    for kind in sorted({r["kind"] for r in rows}):
        own = [i for i, r in enumerate(rows) if r["kind"] == kind]
        q, _, _ = reliabilities([(tuple(rows[i][j] for j in LABELERS), rows[i]["count"]) for i in own])
        truth.update(zip(own, q))
    x = [[float(r[j] == s) for j in LABELERS for s in (1, -1)] + [float(r["kind"] == k) for k in KINDS]
         + [float(r["separated"]), float(r["marked"])] for r in rows]
    w = fit_logistic(np.array(x), np.array([truth[i] for i in range(len(rows))]), np.array([float(r["count"]) for r in rows]))
    score = F.lit(0.0)
    for weight, f in zip(w.tolist(), _features().values()):
        score = score + F.when(f, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-score))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (64-bit key of the text), kind, start, end (code points), base, p (null for base spans): all spans reported."""
    text = F.col("text")
    every = F.flatten(F.filter(F.array(*[_matches(k, base, text) for base in (True, False) for k in KINDS]), lambda x: x.isNotNull()))
    found = (docs.select("doc_id", F.xxhash64("text").alias("tkey"), every.alias("found")).where(F.size("found") > 0)
             .repartition("doc_id", "tkey").dropDuplicates(["doc_id", "tkey"])
             .select("doc_id", "tkey", F.explode("found").alias("f")).select("doc_id", "tkey", "f.*"))
    size = F.length("m").cast("long")
    upto = Window.partitionBy("doc_id", "tkey", "kind", "base").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (found.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
              .where(checked(F.col("kind"), F.col("m"))))
    # a candidate touches a base span when one begins before its end and ends after its start
    first = Window.partitionBy("doc_id", "tkey").orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("doc_id", "tkey").orderBy(F.desc("start"), F.desc("base")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (placed.withColumn("done", F.max(F.when(F.col("base"), F.col("end"))).over(first))
              .withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(after))
              .withColumn("free", (F.coalesce("done", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))))
    spans = stored(placed.where("base or free").select(
        "doc_id", "tkey", "kind", "base", "start", "end", *[v.cast("int").alias(k) for k, v in _votes().items()],
        F.col("m").rlike("[ .()-]").alias("separated"), F.col("m").rlike(r"^\+|@|:").alias("marked")))
    p = span_model(spans)
    return spans.withColumn("p", F.when(~F.col("base"), p)).where(F.col("base") | (F.col("p") >= 0.5)).select(
        "doc_id", "tkey", "kind", "start", "end", "base", "p")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans per row of docs."""
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = find_spans(docs).withColumn("s", F.struct("start", order.alias("o"), "end", "kind", "base"))
    each = spans.groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("t")).agg(
        F.array_sort(F.collect_set("s")).alias("s"), *[F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS])

    def joined(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    none = F.array().cast("array<struct<start:bigint,o:bigint,end:bigint,kind:string,base:boolean>>")
    keys = docs.select("doc_id", F.xxhash64("text").alias("tkey"))
    s = F.coalesce(F.col("s"), none)
    return keys.join(each, keys["doc_id"].eqNullSafe(each["d"]) & (keys["tkey"] == each["t"]), "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.filter(s, lambda x: x["base"])), 256).alias("base_sha256"), joined(s).alias("spans"))
