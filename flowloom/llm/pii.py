"""Personal data by candidate boosting, in DataFrame and Spark ML operations only.

Generators with high recall propose spans, which may overlap. Boosted trees score every candidate from its format and
its context; they learn from the candidates that pass their generator's check (digit sums, ranges, lengths, the address
left after undoing), which is not among the features; what overlaps a base span is left out. Per kind, the threshold is the least score above which enough held-out candidates pass the check.
What passes the check is a base span and always stays; candidates that look just like them by score are added.

Positions come from cutting the text at a generator's matches: lengths of the pieces before a match, summed up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import materialise

KINDS = ("email", "ip", "card", "phone")
#: Candidates (about, a hash sample) that the trees are fitted on.
FIT_ROWS = 20_000
TREES, DEPTH = 12, 3
#: Share of held-out candidates above the threshold that must pass the check, and their least number.
PRECISION, LEAST = 0.9, 30
CONTEXT = 24

# Generators: kind, cheap test that a text can hold a match, pattern. The first four are the base patterns; repeats are
# possessive where no shorter repeat can match, and matches start only where the leftmost one can, so that long runs
# cost linear time and no deep recursion.
_LOCAL = r"[A-Za-z0-9._%+-]"
#: A local part starts where none is under way, or where the match before ended.
_START = r"(?:(?<![A-Za-z0-9._%+-])|\G)"
GENERATORS = (
    ("email", r"@", _START + _LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    (
        "email",
        r"(?i)[(\[{ ](?:at|@)[)\]} ]",
        _START + _LOCAL + r"++ ?(?:[(\[{](?i:at)[)\]}]|@) ?[A-Za-z0-9-]++(?:(?: ?[(\[{](?i:dot)[)\]}] ?|\.| \. )[A-Za-z0-9-]++)++",
    ),
    ("phone", r"[0-9][)]?[ .-][0-9]{3}", r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])"),
)
_KEYWORDS = r"(?i)(mail|contact|phone|tel|call|fax|mobile|card|visa|payment|address|host|server|\bip\b)"


def _candidates(text: Column) -> Column:
    """Array of all proposals of a text: generator, number, piece before, match, context on both sides."""
    none = F.array().cast("array<struct<gen:int,i:int,match:string,gap:int,before:string,after:string>>")
    return F.concat(*[F.when(text.rlike(test), _proposals(text, g, pattern)).otherwise(none) for g, (_, test, pattern) in enumerate(GENERATORS)])


def _proposals(text: Column, g: int, pattern: str) -> Column:
    around = F.transform(
        F.split(text, pattern, -1),
        lambda p: F.struct(F.length(p).alias("size"), F.left(p, F.lit(CONTEXT)).alias("head"), F.right(p, F.lit(CONTEXT)).alias("tail")),
    )
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sides = F.arrays_zip(found.alias("match"), around.alias("before"), F.slice(around, F.lit(2), F.size(around)).alias("after"))

    def proposal(z: Column, i: Column) -> Column:
        before, after = z["before"], z["after"]
        return F.struct(
            F.lit(g).alias("gen"),
            i.alias("i"),
            z["match"].alias("match"),
            before["size"].alias("gap"),
            before["tail"].alias("before"),
            after["head"].alias("after"),
        )

    return F.filter(F.transform(sides, proposal), lambda c: c["match"].isNotNull())  # one piece more than matches


def _luhn(digits: Column) -> Column:
    """Digit sum with every second digit from the right doubled, divisible by ten."""
    d = F.reverse(digits)

    def term(i: Column) -> Column:
        x = d.substr(i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + term(i)) % 10 == 0


def _looks_right() -> Column:
    """Label of a candidate: the base check, or for the extra generators the address left after undoing, or the digits."""
    n = F.length(F.regexp_replace("match", "[^0-9]", ""))
    undone = F.regexp_replace(F.regexp_replace("match", r"(?i) ?[(\[{]at[)\]}] ?", "@"), r"(?i) ?[(\[{]dot[)\]}] ?", ".")
    address = F.regexp_replace(undone, " ", "").rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")
    closed = F.col("match").contains("(") == F.col("match").contains(")")
    return F.when(F.col("gen") == 4, address).when(F.col("gen") == 5, n.between(9, 11) & closed).otherwise(F.col("base"))


def _passes() -> Column:
    """The check of a candidate's kind for the base generators; the extra ones' matches are never base."""
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return (
        F.when(F.col("gen") == 0, F.lit(True))
        .when(F.col("gen") == 1, F.col("match").rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(F.col("gen") == 2, F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .when(F.col("gen") == 3, n.between(8, 15))
        .otherwise(False)
    )


FEATURES = (
    "kind", "size", "digits", "letters", "blanks", "dots", "dashes", "parens", "plus", "groups", "longest",
    "left_space", "left_letter", "left_digit", "left_mark", "right_space", "right_letter", "right_digit", "right_mark",
    "left_keyword", "right_keyword", "left_hex", "right_hex",
)


def _features(c: DataFrame) -> DataFrame:
    """Format of the match and of what stands on both sides of it, as doubles."""
    m, left, right = F.col("match"), F.col("before"), F.col("after")

    def count(pattern: str) -> Column:
        return F.length(m) - F.length(F.regexp_replace(m, pattern, ""))

    def sides(name: str, pattern: str) -> dict[str, Column]:
        return {f"left_{name}": left.rlike(f"(?:{pattern})$"), f"right_{name}": right.rlike(f"^(?:{pattern})")}

    columns = {
        "kind": F.col("kind"),
        "size": F.least(F.length(m), F.lit(80)),
        "digits": F.least(count("[0-9]"), F.lit(40)),
        "letters": F.least(count("[A-Za-z]"), F.lit(40)),
        "blanks": count(" "),
        "dots": count(r"\."),
        "dashes": count("-"),
        "parens": count(r"[()]"),
        "plus": count(r"\+"),
        "groups": F.size(F.split(m, "[^0-9A-Za-z]+")),
        "longest": F.array_max(F.transform(F.split(m, "[^0-9]+"), F.length)),
        **sides("space", r"\s|\A\z"),
        **sides("letter", r"\p{L}"),
        **sides("digit", "[0-9]"),
        **sides("mark", r"[^\s\p{L}0-9]"),
        **sides("hex", r"[0-9a-f]{4}"),
        "left_keyword": left.rlike(_KEYWORDS),
        "right_keyword": right.rlike(_KEYWORDS),
    }
    return c.withColumns({f"f_{k}": columns[k].cast("double") for k in FEATURES})


def candidates(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables from one reading of the texts: rows ``doc_id, _row`` and their proposals with position and check.

    ``_row`` tells rows with one doc_id apart; it is fixed by writing the table.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), _candidates(F.coalesce(F.col(text), F.lit(""))).alias("found"))
    rows = materialise(rows, "proposals")
    each = rows.filter(F.size("found") > 0).select("_row", F.explode("found").alias("c")).select("_row", "c.*")
    upto = Window.partitionBy("_row", "gen").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(upto).cast("long")
    number = {k: i for i, k in enumerate(KINDS)}
    kind = F.element_at(F.array(*[F.lit(number[g[0]]) for g in GENERATORS]), F.col("gen") + 1)
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    each = each.withColumn("kind", kind).withColumn("base", _passes())
    # Digit runs that no kind can be: too short for a card, and no other generator's match.
    digits = F.length(F.regexp_replace("match", "[^0-9]", ""))
    each = each.filter((F.col("gen") != 2) | digits.between(13, 19))
    # What overlaps a base span can't be added, so it is neither learnt from nor counted.
    each = materialise(each.withColumn("label", _looks_right()), "positions")
    spans = each.filter("base").groupBy("_row").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    over = F.exists("_spans", lambda b: (F.col("start") < b["end"]) & (b["start"] < F.col("end")))
    more = each.filter(~F.col("base")).join(spans, "_row", "left").filter(~F.coalesce(over, F.lit(False))).select(*each.columns)
    each = each.filter("base").unionByName(more)
    return rows.select("doc_id", "_row"), materialise(_features(each), "candidates")


@dataclass
class Selector:
    """Fitted trees (None where there is nothing to learn) and the threshold of each kind (above 1: adds nothing)."""

    trees: GBTClassificationModel | None
    thresholds: list[float]

    def score(self, found: DataFrame) -> DataFrame:
        if self.trees is None:
            return found.withColumn("score", F.col("base").cast("double"))
        vector = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(found)
        return self.trees.transform(vector).withColumn("score", vector_to_array("probability")[1])


def _hash(*names: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*names), 8)


def fit(found: DataFrame, fit_rows: int = FIT_ROWS, precision: float = PRECISION) -> Selector:
    """Trees from a hash sample of about ``fit_rows`` candidates, thresholds from all candidates that are held out.

    A quarter of the candidates, by content, is held out. Scores are counted in hundredths per kind, so the driver
    gets at most 404 rows.
    """
    never = [2.0] * len(KINDS)
    n, good = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0))).first()
    if not 0 < good < n:
        return Selector(None, never)
    held = F.pmod(_hash("match", "before"), F.lit(4)) == 0
    share = max(1, round(n / fit_rows))
    drawn = found.filter(~held).filter(F.pmod(_hash("match", "before", "after"), F.lit(share * 4)) < 4)
    sample = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(
        drawn.withColumn("label", F.col("label").cast("double"))
    )
    sample = materialise(sample.select("features", "label"), "sample")
    seen = {r["label"] for r in sample.select("label").distinct().collect()}
    if len(seen) < 2:
        return Selector(None, never)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=5, checkpointInterval=-1).fit(sample)
    selector = Selector(trees, never)
    bins = (
        selector.score(found.filter(held))
        .groupBy("kind", F.floor(F.col("score") * 100).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("good"))
    )
    rows = sorted(((r["kind"], -r["bin"], r["n"], r["good"]) for r in bins.collect()))
    for kind in range(len(KINDS)):
        total = right = 0
        for _, negative, n, good in (r for r in rows if r[0] == kind):
            total, right = total + n, right + good
            if total >= LEAST and right >= precision * total:
                selector.thresholds[kind] = -negative / 100
    return selector


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(
                ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", selector: Selector | None = None, **kw) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``.

    Base spans are the leftmost matches of the base patterns that pass their checks; ``spans`` has these and the added
    ones as kind:start:end, by kind, start and end, in code points, ends exclusive. An added span never overlaps a base
    span. Null and empty texts have none. Repeated rows are read singly and alike. Without candidates of both sorts
    nothing is learnt and nothing added. An empty table gives an empty result. Other columns aren't read.
    """
    rows, found = candidates(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text")
    selector = selector or fit(found, **kw)
    limit = F.element_at(F.array(*[F.lit(x) for x in selector.thresholds]), F.col("kind") + 1)
    span = F.struct("kind", "start", "end")
    scored = selector.score(found).filter(F.col("base") | (F.col("score") >= limit))
    each = scored.groupBy("_row").agg(
        F.collect_set(F.when(F.col("base"), span)).alias("base"), F.collect_set(F.when(~F.col("base"), span)).alias("more")
    )
    apart = F.filter("more", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    each = each.withColumn("more", apart)
    out = rows.join(each, "_row", "left")
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    out = out.withColumn("base", F.coalesce("base", none)).withColumn("more", F.coalesce("more", none))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "more")).alias("spans"),
        F.size("more").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the spans of ``found`` (``doc_id, spans``) replaced by their kind in brackets.

    Overlapping spans are one; doc_id must be unique in ``found``. Documents without spans stay as they are.
    """
    cuts = F.array_sort(
        F.transform(
            F.filter(F.split("spans", ","), lambda s: s != ""),
            lambda s: F.struct(
                F.split(s, ":")[1].cast("int").alias("start"), F.split(s, ":")[2].cast("int").alias("end"), F.split(s, ":")[0].alias("kind")
            ),
        )
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.col(text)

    def step(state: Column, c: Column) -> Column:
        mark = F.concat(state["out"], F.substring(whole, state["at"] + 1, c["start"] - state["at"]), F.lit("["), c["kind"], F.lit("]"))
        return F.when(c["start"] >= state["at"], F.struct(c["end"].alias("at"), mark.alias("out"))).otherwise(
            F.struct(F.greatest(state["at"], c["end"]).alias("at"), state["out"].alias("out"))
        )

    done = F.aggregate("_cuts", zero, step, lambda s: F.concat(s["out"], F.substring(whole, s["at"] + 1, F.lit(2147483647))))
    marked = docs.join(found.select(F.col(doc_id).alias("_id"), cuts.alias("_cuts")), F.col(doc_id).eqNullSafe(F.col("_id")), "left")
    new = F.when(F.size("_cuts") > 0, done).otherwise(whole)
    return marked.withColumn("_new", new).select(*[F.col("_new").alias(c) if c == text else F.col(c) for c in docs.columns])
