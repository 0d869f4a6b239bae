"""Operator 7: personal data, by base patterns and boosted candidates, in DataFrame functions only.

Generators propose overlapping spans: what the base patterns match, valid or not, and looser shapes (numbers inside longer digit
runs, disguised addresses). Format and context of each become features. Boosted trees, fitted on the driver on a bounded sample,
are written out as one Spark expression; spans above the calibrated threshold of their kind join the base spans.
There are no labels for personal data: accepted base spans and disguised forms of them teach "yes", failed base
matches and candidates that touch no base match teach "no", and what overlaps a base match teaches nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm import boosting
from sensorframe.llm.common import own_names, stage

KINDS = ("email", "ip", "card", "phone")
#: Documented bounds of the fit: documents looked at (in the mean) and candidates taken.
SAMPLE_DOCUMENTS, SAMPLE_CANDIDATES = 20_000, 20_000
PRECISION = 0.95

# Fixed patterns of the contract, with possessive repeats and a start that is no inner part of a run, so that long runs cost no
# quadratic time: the leftmost match is the same.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A quick look whether a pattern can match at all.
SIGN = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
LOOSER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?|(?<![0-9+(]|[0-9][ .-])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-]))[0-9]{3,4}[ .-][0-9]{4}(?![0-9])",
}
LOOSER_SIGN = {"email": r"(?i)[ (\[]at[ )\]]", "ip": r"\[\.\]", "card": r"[0-9]{4}", "phone": r"[0-9]{3,4}[ .-][0-9]{4}"}
CUES = r"(?i)\b(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|credit|ip|host|server|address)\b"
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|(?<=0))"
CHUNK = 512


def _positions(parts: Column) -> Column:
    """``start, stop, m`` of every second part. Parts are worked off in chunks, so that many matches cost no quadratic time."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / CHUNK).cast("int")), lambda c: F.slice(parts, c * CHUNK + 1, CHUNK))
    sized = F.transform(chunks, lambda p: F.struct(p.alias("p"), F.aggregate(p, F.lit(0), lambda a, x: a + F.length(x)).alias("n")))
    ends = F.aggregate(sized, F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c["n"])))

    def walk(c: Column, begin: Column) -> Column:
        def step(a, x):
            stop = a["at"] + F.length(x)
            more = F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), stop.alias("stop"), x.alias("m"))))
            return F.struct(stop.alias("at"), (~a["odd"]).alias("odd"), F.when(a["odd"], more).otherwise(a["out"]).alias("out"))

        start = F.struct(begin.alias("at"), F.lit(False).alias("odd"), F.expr("cast(array() as array<struct<start: int, stop: int, m: string>>)").alias("out"))
        return F.aggregate(c["p"], start, step, lambda a: a["out"])

    return F.flatten(F.zip_with(sized, F.slice(ends, 1, F.size(sized)), walk))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def digit(i: Column) -> Column:
        v = F.substr(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + digit(i))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _features(c: Column) -> list[tuple[str, Column]]:
    m, before, after = c["m"], c["before"], c["after"]
    flag = {
        "plus": m.startswith("+"), "paren": m.contains("("), "luhn": _luhn(m), "octets": F.replace(F.replace(m, F.lit("[.]"), F.lit(".")), F.lit(" "), F.lit("")).rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "at": m.contains("@"), "spelt": m.rlike(r"(?i)[ (\[]at[ )\]]"), "glued_before": before.rlike(r"[\p{L}0-9_]$"), "glued_after": after.rlike(r"^[\p{L}0-9_]"),
        "cue": before.rlike(CUES),
    }
    number = {
        "kind": c["kind"], "length": F.length(m), "digits": F.length(_digits(m)), "marks": F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        "groups": F.size(F.split(F.trim(F.regexp_replace(m, "[^0-9]+", " ")), " ")),
    }
    return [(n, v.cast("double")) for n, v in number.items()] + [(n, v.cast("double")) for n, v in flag.items()]


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def _of_kind(kind: str):
    return lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["m"].alias("m"), _valid(kind, x["m"]).alias("ok"))


def candidates(documents: DataFrame) -> DataFrame:
    """All columns of ``documents`` with ``_base`` (accepted spans: kind, start, stop, m), ``_raw`` (the failed ones too) and ``_found``
    (candidates with features and label). Names that begin with an underscore and a kind are made on the way."""
    # The character that marks matches is nowhere else in the text; positions stay.
    clean = F.translate(F.coalesce(F.col("text"), F.lit("")), "\x01", "\x02")
    keep = [F.col(f"`{c}`") for c in documents.columns]
    out = documents.select(*keep, clean.alias("_clean"))

    def cut(pattern: str, sign: str) -> Column:
        marked = F.split(F.regexp_replace(F.col("_clean"), pattern, "\x01$0\x01"), "\x01")
        return F.when(F.col("_clean").rlike(sign), marked).otherwise(F.array(F.lit("")))

    out = out.select("*", *(cut(BASE[k], SIGN[k]).alias(f"_{k}") for k in KINDS), *(cut(LOOSER[k], LOOSER_SIGN[k]).alias(f"_{k}_looser") for k in KINDS))
    spans = []
    for name in ("", "_looser"):
        spans += [F.transform(_positions(F.col(f"_{k}{name}")), _of_kind(k)).alias(f"_{k}{name}") for k in KINDS]
    out = out.select(*keep, "_clean", *spans)
    out = out.select(*keep, "_clean", F.concat(*(f"_{k}" for k in KINDS)).alias("_raw"), F.concat(*(f"_{k}_looser" for k in KINDS)).alias("_more"))
    out = out.select(*keep, "_clean", "_raw", F.filter("_raw", lambda r: r["ok"]).alias("_base"), F.array_union("_raw", "_more").alias("_all"))

    def described(x):
        same = F.filter("_raw", lambda r: (r["kind"] == x["kind"]) & (r["start"] == x["start"]) & (r["stop"] == x["stop"]))
        touched = F.exists("_raw", lambda r: _overlap(r, x))
        label = F.when(F.size(same) > 0, same[0]["ok"].cast("double")).when(~touched, 0.0)
        before = F.substr(F.col("_clean"), F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["m"].alias("m"), before.alias("before"), F.substr(F.col("_clean"), x["stop"] + 1, F.lit(8)).alias("after"), label.alias("label"))

    return out.select(*keep, "_base", F.transform("_all", described).alias("_found"))


def _disguised(c: Column) -> Column:
    """Forms in which an accepted address or number might hide, as further candidates that teach "yes"."""
    spelt = F.replace(F.replace(c["m"], F.lit("@"), F.lit(" at ")), F.lit("."), F.lit(" dot "))
    bare = F.regexp_replace(c["m"], r"^\+[0-9]{1,3}[ .-]?(?=\(?[0-9]{3})", "")
    m = F.when(c["kind"] == 0, spelt).when((c["kind"] == 3) & bare.rlike("^" + LOOSER["phone"]), bare)
    return F.struct(*(c[n].alias(n) for n in ("kind", "start", "stop")), m.alias("m"), *(c[n].alias(n) for n in ("before", "after", "label")))


def fit(documents: DataFrame, docs: int = SAMPLE_DOCUMENTS, rows: int = SAMPLE_CANDIDATES) -> tuple[boosting.Trees, list[float]]:
    """The trees and a threshold for each kind, from at most ``rows`` distinct candidates of about ``docs`` documents, picked by hash."""
    share = int(1_000_000 * min(1.0, docs / max(1, documents.count())))
    picked = documents.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share).select("text").where("text rlike '[0-9@]'")
    # Written first: a filter behind the explode would be pushed down and work the spans out again.
    found = stage(candidates(picked).select("_found"), "candidates").select(F.explode("_found").alias("c")).where("c.label is not null")
    more = found.where("c.label = 1").select(_disguised(F.col("c")).alias("c")).where("c.m is not null")
    rated = found.unionByName(more).select(F.col("c.kind").alias("k"), F.col("c.label").alias("label"), F.col("c.m").alias("m"), *(v.alias(n) for n, v in _features(F.col("c"))))
    taken = rated.distinct().orderBy(F.xxhash64("k", "m"), *rated.columns).limit(rows).drop("m").collect()
    if not taken:
        return boosting.fit(np.zeros((0, 1)), np.zeros(0)), [2.0] * len(KINDS)
    table = np.array([tuple(r) for r in taken], float)
    kind, y, x = table[:, 0], table[:, 1], table[:, 2:]
    hold = np.arange(len(y)) % 3 == 0
    model = boosting.fit(x[~hold], y[~hold], trees=20, depth=3, rate=0.3)
    # The lowest score from which on the held-back third is as precise as asked for, one error always allowed; no spans of a kind
    # without examples.
    cuts = []
    for k in range(len(KINDS)):
        of = hold & (kind == k)
        score, good = model.margin(x[of]), y[of] == 1
        order = np.argsort(-score, kind="stable")
        wrong = np.cumsum(~good[order])
        last = np.flatnonzero((wrong <= np.maximum(1, (1 - PRECISION) * np.arange(1, len(order) + 1))) & good[order])
        # Half way to what comes next; even odds where nothing does. Spark and numpy may add the trees up in another order.
        after = score[order][last[-1]:last[-1] + 2] if len(last) else score[:0]
        cuts.append(1e9 if not len(last) else float(max(0.0, after.mean() - 1e-6)) if len(after) == 2 else 0.0)
    return model, cuts


def detect(documents: DataFrame, model: boosting.Trees, cuts: list[float]) -> DataFrame:
    """All columns of ``documents`` with ``_base`` and ``_spans`` (kind, start, stop; base spans and added ones, by kind and start)."""
    keep = [F.col(f"`{c}`") for c in documents.columns]
    near = candidates(documents)
    fresh = F.filter("_found", lambda c: ~F.exists("_base", lambda b: _overlap(b, c)))
    rated = F.transform(fresh, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), F.struct(*(v.alias(n) for n, v in _features(c))).alias("x")))
    near = near.select(*keep, "_base", rated.alias("_rated"))
    names = [n for n, _ in _features(F.struct(F.lit(0).alias("kind"), F.lit("").alias("m"), F.lit("").alias("before"), F.lit("").alias("after")))]

    def scored(c):
        cut = reduce(lambda a, k: a.when(c["kind"] == k, cuts[k]), range(1, len(KINDS)), F.when(c["kind"] == 0, cuts[0]))
        margin = model.expression([c["x"][n] for n in names])
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), (margin - cut).alias("over"))

    near = near.select(*keep, "_base", F.filter(F.transform("_rated", scored), lambda c: c["over"] >= 0).alias("_rated"))
    # Of added spans that overlap, the better one stays; of equals the first.
    sort = F.array_sort(F.transform("_rated", lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind"), c["over"].alias("over"))))

    def choose(a, c):
        last = F.try_element_at(a, F.lit(-1))
        clash = last.isNotNull() & (c["start"] < last["stop"])
        return F.when(~F.coalesce(clash, F.lit(False)), F.concat(a, F.array(c))).when(c["over"] > last["over"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(c))).otherwise(a)

    none = F.expr("cast(array() as array<struct<start: int, stop: int, kind: int, over: double>>)")
    added = F.aggregate(sort, none, choose)
    plain = [F.transform(s, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))) for s in (F.col("_base"), added)]
    return near.select(*keep, plain[0].alias("_base"), F.array_sort(F.concat(*plain)).alias("_spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))))


def report(documents: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row; the counts are of base spans.

    A null text is empty and has no spans. Repeated rows and null ids are reported each, an empty table gives no rows; other
    columns are not looked at.
    """
    model, cuts = fit(documents)
    found = detect(documents.select("doc_id", "text"), model, cuts)

    def count(k: int) -> Column:
        return F.size(F.filter("_base", lambda b: b["kind"] == k)).cast("bigint")

    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(spans_text(F.array_sort("_base")), 256).alias("base_sha256"), spans_text(F.col("_spans")).alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with every span of ``text`` replaced by its kind in brackets, such as ``[EMAIL]``; overlapping spans by the first one's.

    All columns stay, whatever their names. A null text stays null, an empty one empty; repeated rows and null ids are redacted each; an
    empty table gives no rows.
    """
    model, cuts = fit(documents)
    # Names of working columns begin with an underscore.
    found = detect(own_names(documents, "text"), model, cuts)
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(a, s):
        new = s["start"] >= a["at"]
        between = F.substr(F.col("text"), a["at"] + 1, s["start"] - a["at"])
        out = F.when(new, F.concat(a["out"], between, F.get(name, s["kind"]))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), out.alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, F.length("text"))))
    text = F.when(F.size("_spans") > 0, done).otherwise(F.col("text"))
    return found.select(*(text.alias("text") if c == "text" else F.col(f"c{i}") for i, c in enumerate(documents.columns))).toDF(*documents.columns)
