"""Personal data by weak supervision, DataFrame operations only.

Base spans, of four kinds, are exact patterns with a check each and always stay. Looser patterns propose further spans: national numbers, phones without a plus,
hidden mail addresses, titled names, account numbers and secrets. Labelers vote on every span: its shape, a gazetteer, words around it that speak for or
against it, and whether it stands alone; they often disagree. How often each combination of votes occurs in the whole corpus, a table of bounded size, is all
that expectation-maximisation needs to estimate the labelers' reliabilities; its posteriors are the soft labels of a naive Bayes classifier over other
features of a span (kind, length, digits, capitals, the mark and the word before it), which decides on the proposed ones.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_one, read_table, saved

# Fixed values. A run of a class is taken from its start, or from the end of the match before (\G): a later start in the run would meet
# the same end of the run, so the matches are the leftmost ones, and a long run is read once. Possessive where nothing could be given back.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
PROPOSED = {
    "national_id": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "local_phone": r"(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "hidden_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}\b",
    "account": r"(?<![0-9A-Za-z+.-])[0-9](?:[ -]?[0-9]){8,}+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sra)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
KINDS = [*BASE, *PROPOSED]
STRICT = {
    "email": r"\.[A-Za-z]{2,24}$",
    "ip": r"^(?!0+\.)[0-9.]+$",
    "card": r"^[3-6]",
    "phone": r"^\+[1-9]",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "local_phone": r"^\(?[2-9]",
    "hidden_email": r"(?i)(com|org|net|edu|de|fr|es)$",
    "account": r"^(?!([0-9])[ -]?(?:\1[ -]?)+$)(?!0)",
    "secret": r"^(?:[0-9a-f]{32,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9].*[0-9].*[0-9]).{20,})=*$",
    "name": r"\p{Ll}$",
}
GAZETTEER = {
    "email": r"(?i)@(mail|gmail|yahoo|outlook|example|proton)",
    "hidden_email": r"(?i)(mail|gmail|yahoo|outlook|example)",
    "secret": r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk-|pk_|xox[abprs]-|eyJ|AIza|glpat-)",
    "name": r"\b(James|Mary|John|Anna|Peter|Maria|Paul|Laura|Thomas|Sophie|Hans|Claire|Jean|Carmen|Luis|Smith|Jones|Brown|Müller|Schmidt|Garcia|Martin|Bernard|Lopez)\b",
    "national_id": r"^(?:078-05-1120|219-09-9999)$",
}
FOR = r"(?i)\b(e-?mail|mail|phone|tel|telephone|call|mobile|fax|contact|ssn|social security|passport|card|visa|credit|ip|address|account|konto|cuenta|compte|iban|token|secret|password|passwd|api|key|bearer|name|signed|telefon|anruf|téléphone|appel|correo|teléfono|adresse)\b"
AGAINST = r"(?i)\b(version|release|page|isbn|issn|section|chapter|figure|table|order|invoice|part|build|serial|commit|sha1|sha256|md5|checksum|hash|digest|revision|doi)\b"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Code points of context on either side.
CONTEXT = 32
VOTES = ["shape", "gazetteer", "context", "alone"]
FEATURES = ["kind", "length", "digits", "capitals", "mark", "word"]
#: The words before a span fall into so many classes.
WORD_CLASSES = 64


def matches(text: Column, pattern: str) -> Column:
    """(start, end, value) of the leftmost non-overlapping matches, in code points, end exclusive."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("value"))
    none = F.array().cast("array<struct<start: int, end: int, value: string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.coalesce(F.length(x["1"]), F.lit(0))
        return F.struct(end.alias("at"), F.when(x["1"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["1"].alias("value")))).alias("out"))

    pairs = F.transform(parts, lambda p: F.struct(p["gap"].alias("0"), p["value"].alias("1")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def passes(kind: str, value: Column) -> Column:
    """The check of a base kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(10, 15)

    def luhn(total: Column, k: Column) -> Column:
        d = F.substring(F.reverse(digits), k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    sums = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), luhn)
    return F.when(F.length(digits).between(14, 19), sums % 10 == 0).otherwise(False)


def might_have(kind: str, text: Column) -> Column:
    """A cheap condition that every text with a match meets."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "hidden_email":
        return text.rlike(r"(?:[(\[ ]dot[)\] ])")
    if kind == "secret":
        return text.rlike(PROPOSED[kind])
    if kind == "name":
        return text.rlike(r"\b(?:M|D|P|H|F|S)[a-z]{1,8}\.? \p{Lu}")
    return text.rlike("[0-9]")


def spans_of(text: Column) -> tuple[Column, Column]:
    """Base spans and proposed ones, each (start, kind's number, end, value)."""
    kind_of = "array<struct<start: int, kind: int, end: int, value: string>>"

    def of(kind: str, pattern: str) -> Column:
        n = KINDS.index(kind)
        found = F.transform(matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
        if kind in BASE:
            found = F.filter(found, lambda m: passes(kind, m["value"]))
        return F.when(might_have(kind, text), found).otherwise(F.array().cast(kind_of))

    return F.array_sort(F.concat(*[of(k, p) for k, p in BASE.items()])), F.array_sort(F.concat(*[of(k, p) for k, p in PROPOSED.items()]))


def judged(span: Column, text: Column) -> Column:
    """The span with its votes, 1 for, -1 against, 0 abstains, and its features."""
    before = F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
    after = F.substring(text, span["end"] + 1, F.lit(CONTEXT))
    value = span["value"]

    def by_kind(patterns: dict[str, str], yes: int, no: int) -> Column:
        out = F.lit(0)
        for k, p in patterns.items():
            out = F.when(span["kind"] == KINDS.index(k), F.when(value.rlike(p), yes).otherwise(no)).otherwise(out)
        return out

    around = F.when(before.rlike(AGAINST), -1).when(before.rlike(FOR) | after.rlike(FOR), 1).otherwise(0)
    alone = F.when(before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]"), -1).otherwise(1)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    capitals = F.length(F.regexp_replace(value, "[^A-Z]", ""))
    mark = F.coalesce(F.nullif(F.instr(F.lit("\"'=:(<@#/"), F.substring(before, -1, 1)), F.lit(0)), F.when(before.rlike(r"\s$"), -1).otherwise(0))
    word = F.lower(F.regexp_extract(before, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1))
    return F.struct(
        span["start"].alias("start"), span["kind"].alias("kind"), span["end"].alias("end"),
        by_kind(STRICT, 1, -1).alias("shape"), by_kind(GAZETTEER, 1, 0).alias("gazetteer"), around.alias("context"), alone.alias("alone"),
        F.least(F.expr("cast(8 as int)"), F.floor(F.length(value) / 4).cast("int")).alias("length"), F.least(F.lit(20), digits).alias("digits"),
        F.least(F.lit(8), capitals).alias("capitals"), F.when(before == "", -2).otherwise(mark).cast("int").alias("mark"), F.pmod(F.hash(word), F.lit(WORD_CLASSES)).alias("word"),
    )


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base and proposed, arrays of judged spans of the column `text`; proposed spans overlap no base span and not one another.

    A null text is empty and has no span. Columns of docs called base, proposed, base_found or proposed_found are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base, proposed = spans_of(whole)
    found = docs.withColumn("base_found", base).withColumn("proposed_found", proposed)
    free = F.filter("proposed_found", lambda p: ~F.exists("base_found", lambda b: (b["start"] < p["end"]) & (p["start"] < b["end"])))

    def first_of(acc: Column, p: Column) -> Column:
        return F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= p["start"]), F.array_append(acc, p)).otherwise(acc)

    free = F.when(F.size("proposed_found") > 0, F.aggregate(free, F.array().cast("array<struct<start: int, kind: int, end: int, value: string>>"), first_of)).otherwise(F.col("proposed_found"))
    return found.withColumn("base", F.transform("base_found", lambda s: judged(s, whole))).withColumn("proposed", F.transform(free, lambda s: judged(s, whole))).drop("base_found", "proposed_found")


def first_guess(votes: tuple[int, ...]) -> float:
    """Where expectation-maximisation starts; a vote against counts more than one for."""
    return min(0.95, max(0.05, 0.5 + sum(0.2 if v > 0 else 0.5 * v for v in votes)))


def reliabilities(patterns: dict[tuple, int], rounds: int = 50) -> dict[tuple, float]:
    """Posterior of each (kind, votes...) by Dawid-Skene expectation-maximisation over their counts."""
    post = {p: first_guess(p[1:]) for p in patterns}
    for _ in range(rounds):
        prior, seen = defaultdict(lambda: 1.0), defaultdict(lambda: 2.0)
        vote = [[defaultdict(lambda: 0.1), defaultdict(lambda: 0.1)] for _ in VOTES]
        mass = [0.3, 0.3]
        for p, n in patterns.items():
            prior[p[0]] += n * post[p]
            seen[p[0]] += n
            for y, w in ((1, n * post[p]), (0, n * (1 - post[p]))):
                mass[y] += w
                for j, v in enumerate(p[1:]):
                    vote[j][y][v] += w
        new = {}
        for p in patterns:
            odds = math.log(prior[p[0]] / (seen[p[0]] - prior[p[0]] + 1e-9))
            odds += sum(math.log((vote[j][1][v] / mass[1]) / (vote[j][0][v] / mass[0])) for j, v in enumerate(p[1:]))
            new[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        change = max((abs(new[p] - post[p]) for p in new), default=0)
        post = new
        if change < 1e-9:
            break
    return post


def train(found: DataFrame, labelers: tuple[str, ...] = tuple(VOTES)) -> dict[str, dict]:
    """Log-odds by feature and value, and under "" the prior's, from with_spans(). The spans are counted by votes, feature and value: at most some hundred
    thousand rows, however many spans. labelers: those that vote; the others abstain."""
    spans = found.select(F.explode(F.concat("base", "proposed")).alias("s")).select("s.*")
    votes = [F.col(v) if v in labelers else F.lit(0).alias(v) for v in VOTES]
    features = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES]))
    counts = spans.select(F.col("kind").alias("of"), *votes, features.alias("x")).groupBy("of", *VOTES, "x").count().select("of", *VOTES, "x.*", "count").collect()
    pattern = lambda r: (r["of"], *(r[v] for v in VOTES))
    post = reliabilities({pattern(r): r["count"] for r in counts if r["feature"] == "kind"})
    sums = {f: defaultdict(lambda: [0.5, 0.5]) for f in FEATURES}
    mass = [1.0, 1.0]
    for r in counts:
        p = post[pattern(r)]
        for y, w in ((1, r["count"] * p), (0, r["count"] * (1 - p))):
            mass[y] += w if r["feature"] == "kind" else 0
            sums[r["feature"]][r["value"]][y] += w
    return {"": math.log(mass[1] / mass[0])} | {f: {v: math.log((w[1] / mass[1]) / (w[0] / mass[0])) for v, w in by.items()} for f, by in sums.items()}


def accepted(span: Column, model: dict) -> Column:
    """Whether the classifier takes a proposed span."""
    score = F.lit(model[""])
    for f in FEATURES:
        part = F.lit(0.0)
        for v, w in model[f].items():
            part = F.when(span[f] == v, w).otherwise(part)
        score = score + part
    return score > 0


def all_spans(model: dict) -> Column:
    """Base spans and the accepted ones, in order."""
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    return F.array_sort(F.concat(F.transform("base", bare), F.transform(F.filter("proposed", lambda s: accepted(s, model)), bare)))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, labelers: tuple[str, ...] = tuple(VOTES)) -> DataFrame:
    """A row for each row of docs: doc_id, base and spans, arrays of (start, kind, end).

    The texts are read once. Repeated rows have their own rows, an empty table gives none, other columns are not read.
    """
    found = saved(with_spans(docs.select("doc_id", "text")).drop("text"), "pii")
    model = train(found, labelers)
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.withColumn("spans", all_spans(model)).withColumn("base", F.array_sort(bare)).drop("proposed")


def masked(docs: DataFrame) -> DataFrame:
    """docs, all its columns, with each span of the text replaced by its kind in capitals and brackets; of overlapping spans the first.

    n_chars, if there is one, follows the new text. A null text stays null, an empty one empty; repeated rows have rows of their own; an empty table gives none.
    """
    # The spans are found once; each row keeps them beside it until the classifier is trained.
    found = saved(with_spans(in_one(docs), "row.text"), "pii-rows")
    model = train(found.select("base", "proposed"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("row.text")

    def step(acc: Column, s: Column) -> Column:
        longer = F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1)).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], longer).otherwise(acc)

    whole = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = found.select("row", all_spans(model).alias("spans")).withColumn("masked", F.when(F.size("spans") > 0, whole).otherwise(text))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(F.encode(written(F.col("base")), "UTF-8"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
