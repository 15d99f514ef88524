"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

Base spans (email, ip, card, phone, each by its fixed pattern and check) are always kept. Wider generators propose further
spans, without upper bounds: digit groups with no, single or any separators, as a card and as a phone number; addresses
with the sign written out; and long runs of letters and digits, as a secret (a key or token). A proposal is described by
its format (lengths, digits, separators, check digit) and its context (neighbouring characters, words before it), scored by
gradient-boosted trees, and passes at the threshold of its kind if no base span overlaps it; of overlapping proposals that
pass the best stays.

The labels of the fit don't hang on what the base patterns find. Into snippets around a place of SAMPLE_DOCS documents (first
by a hash of the id) variants are planted: cards with other separators or a wrong digit, phone numbers without the "+",
written addresses and secrets, with and without a word before them; and, as what is none, dates, amounts, versions, book and
item numbers, file names. A proposal is positive if it is just the planted span and of its kind, negative if it is another
that meets a planted one, or has too few or too many digits; other proposals of the snippets aren't known and teach nothing.
The trees are fitted by Spark's ML library on SAMPLE_SPANS proposals at most, of three folds in four; on the fourth each
kind's threshold is set, below the least score above which PRECISION of the proposals are positive. The fitted trees become
column expressions, so scoring is code-generated like any projection. Everything on the way is DataFrame functions.

Matches are located without Python: the pieces between matches and the matches give running lengths, in code points.

Defined cases: null text is the empty text; no span gives the empty string; without documents no model is fitted and only
base spans are returned; repeated rows each give a row; an empty table an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import Workspace, whole_row

KINDS = ("email", "ip", "card", "phone")
#: Of all spans; the base patterns know no secrets.
ALL_KINDS = (*KINDS, "secret")

# The base patterns. Lookbehinds and possessive quantifiers only save steps; the matches are the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "plain": r"(?<![0-9])[0-9]{7,}+",
    "joined": r"(?<![0-9])[0-9]++(?:[\x20./-][0-9]++)++",
    "loose": r"(?<![0-9(])\(?+[0-9](?:[\x20()./-]*+[0-9])++",
    "written": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    "token": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+=*+",
}
#: Least digits of a proposed number.
LEAST_DIGITS = 7
#: A text without this can't match, so its patterns aren't run.
_DIGITS = r"[0-9][0-9 ()./-]{5}"
MAY = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit("[0-9][ -]?[0-9]")),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "plain": lambda t: F.rlike(t, F.lit(_DIGITS)),
    "joined": lambda t: F.rlike(t, F.lit(_DIGITS)),
    "loose": lambda t: F.rlike(t, F.lit(_DIGITS)),
    "written": lambda t: F.contains(t, F.lit("at)")) | F.contains(t, F.lit("at]")),
    "token": lambda t: F.rlike(t, F.lit("[0-9][A-Za-z_+/-]|[A-Za-z_+/-][0-9]")),
}
#: Kinds that a generator's spans are proposed as.
AS = {**{k: (k,) for k in KINDS}, "plain": ("card", "phone"), "joined": ("card", "phone"), "loose": ("card", "phone"), "written": ("email",), "token": ("secret",)}
LEFT, RIGHT = 24, 8
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

SAMPLE_DOCS, SAMPLE_SPANS = 1000, 40000
TREES, DEPTH, PRECISION, FOLDS = 16, 4, 0.98, 4
#: Words of a snippet on each side of what is planted.
AROUND = 12


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn_sum(number: Column) -> Column:
    """Of a string of digits; the sum runs from the right."""
    turned = F.reverse(number)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(turned, k, F.lit(1)).cast("int")
        double = d * 2
        return total + F.when(k % 2 == 1, d).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add)


def luhn(number: Column) -> Column:
    return luhn_sum(number) % 10 == 0


def is_base(source: Column, span: Column) -> Column:
    n = F.length(digits(span))
    return (
        F.when(source == "email", True)
        .when(source == "ip", F.rlike(span, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$")))
        .when(source == "card", n.between(16, 19) & F.when(n.between(16, 19), luhn(digits(span))).otherwise(False))
        .when(source == "phone", n.between(8, 15))
        .otherwise(False)
    )


def proposals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each base match and each proposal; documents without any have one row with null kind.

    row (number of the document), id, source, kind, start, end, span, left, right, base.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.rlike(text, F.lit("[0-9]")).alias("has_digit"))
    text = F.col("text")

    def found(name: str, pattern: str) -> Column:
        may = MAY[name](text)
        spans = F.when(may if name in ("email", "written") else F.col("has_digit") & may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        return F.struct(F.lit(name).alias("source"), spans.alias("spans"), F.when(F.size(spans) > 0, F.split(text, pattern)).alias("gaps"))

    lists = F.filter(F.array(*(found(n, p) for n, p in {**BASE, **WIDE}.items())), lambda x: F.size(x["spans"]) > 0)

    def located(x: Column) -> Column:
        return F.transform(
            x["spans"],
            lambda span, k: F.struct(
                x["source"].alias("source"),
                k.alias("k"),
                span.alias("span"),
                F.length(F.get(x["gaps"], k)).alias("gap"),
                F.right(F.get(x["gaps"], k), F.lit(LEFT)).alias("left"),
                F.left(F.get(x["gaps"], k + 1), F.lit(RIGHT)).alias("right"),
            ),
        )

    rows = docs.select("id", F.monotonically_increasing_id().alias("row"), lists.alias("lists"))
    rows = rows.select("id", "row", F.explode_outer(F.flatten(F.transform("lists", located))).alias("x")).select("id", "row", "x.*").repartition("row")
    upto = Window.partitionBy("row", "source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.length("span")).over(upto)).withColumn("start", F.col("end") - F.length("span"))
    kinds = F.element_at(F.create_map(*(F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for pair in AS.items() for v in pair)), F.col("source"))
    named = ends.withColumn("base", F.coalesce(is_base(F.col("source"), F.col("span")), F.lit(False)))
    numbers = F.col("source").isin("plain", "joined", "loose")
    proposed = F.col("base") | (F.col("source").isin(*WIDE) & (~numbers | (F.length(digits(F.col("span"))) >= LEAST_DIGITS)))
    # a match that fails its check stays as a row without a kind, so that its document has a row
    return named.withColumn("kind", F.explode_outer(F.when(proposed, kinds)))


KEYWORDS = {  # fixed values: words that stand before such data
    "phone": "phone|tel|call|fax|mobile|cell|handy|ruf|appel|llame|whatsapp",
    "card": "card|visa|master|amex|karte|konto|carte|tarjeta|account|iban",
    "mail": "mail|contact|write|reach",
    "secret": "token|key|secret|password|passwd|pwd|auth|bearer",
}


def features(span: Column, left: Column, right: Column, kind: Column) -> dict[str, Column]:
    number = digits(span)
    n = F.length(number)

    def many(pattern: str) -> Column:
        return F.length(span) - F.length(F.regexp_replace(span, pattern, ""))

    own = {
        "long": F.length(span),
        "digits": n,
        "lower": many("[a-z]"),
        "upper": many("[A-Z]"),
        "hex": F.rlike(span, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "turns": F.size(F.split(span, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")),
        "kinds_of_characters": F.size(F.array_distinct(F.split(F.left(span, F.lit(256)), ""))),
        "spaces": many(r"\x20"),
        "dots": many(r"\."),
        "hyphens": many("[-_]"),
        "brackets": many(r"[()\[\]]"),
        "slashes": many("/"),
        "groups": F.size(F.filter(F.split(span, "[^0-9]+"), lambda x: x != "")),
        "longest": F.coalesce(F.array_max(F.transform(F.split(span, "[^0-9]+"), F.length)), F.lit(0)),
        "first_group": F.length(F.regexp_extract(span, "[0-9]+", 0)),
        "last_group": F.length(F.regexp_extract(span, "([0-9]+)[^0-9]*$", 1)),
        "check": F.when(n.between(13, 19), luhn(number)).otherwise(False),
        "fits": is_base(kind, span),  # digits as its kind has them
        "zero": F.startswith(number, F.lit("0")),
        "year": F.rlike(span, F.lit(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)")),
        "book": F.rlike(number, F.lit("^97[89]")),
        "joined_left": F.rlike(left, F.lit(r"[\p{L}\p{N}_]$")),
        "joined_right": F.rlike(right, F.lit(r"^[\p{L}\p{N}_]")),
        "digits_left": F.rlike(left, F.lit(r"[0-9][\x20()./+-]{0,3}$")),
        "digits_right": F.rlike(right, F.lit(r"^[\x20()./+-]{0,3}[0-9]")),
        "colon": F.rlike(left, F.lit(r"[:=]\s*[\"']?$")),
        "quoted": F.rlike(left, F.lit("[\"']$")),
        "money": F.rlike(F.concat(left, F.lit("|"), right), F.lit(r"[$€£%]\s*\|?")),
        **{f"said_{k}": F.rlike(left, F.lit(f"(?i)(?:{words})")) for k, words in KEYWORDS.items()},
        **{f"as_{k}": kind == k for k in ALL_KINDS},
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"f_{k}") for k, v in own.items()}


def placed(rows: DataFrame) -> DataFrame:
    """rows with `covered`: a base span of the document overlaps."""
    by = Window.partitionBy("row").orderBy("start", "end")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(by.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return rows.withColumn("covered", F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False)))


@dataclass
class Trees:
    """Boosted trees as nested tuples (feature, border, left, right) or leaf values; weights; least score of each kind."""

    names: list[str]
    trees: list
    weights: list[float]
    borders: dict[str, float]

    def score(self, of: dict[str, Column]) -> Column:
        columns = list(of.values())

        def column(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            k, border, left, right = tree
            return F.when(columns[k] <= border, column(left)).otherwise(column(right))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + column(tree) * weight
        return 1 / (1 + F.exp(-2 * total))

    def border(self, kind: Column) -> Column:
        return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in self.borders.items()), F.lit(2.0))


def _nested(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _nested(node.leftChild()), _nested(node.rightChild())


def variants(seed: Column) -> list[tuple[str | None, str, Column]]:
    """What is planted: kind (None: no personal data), words before it, and the text; all hang on `seed` only."""
    code = F.sha2(seed, 256)
    number = F.translate(code, "abcdef", "370518")  # 64 digits
    letters = F.translate(code, "0123456789", "nrstlmeaio")

    def part(at: int, n: int) -> Column:
        return F.substring(number, at, n)

    def grouped(c: Column, separator: str, *sizes: int) -> Column:
        edges = [1]
        for n in sizes:
            edges.append(edges[-1] + n)
        return F.concat_ws(separator, *(F.substring(c, a, n) for a, n in zip(edges, sizes)))

    wrong = F.concat(F.lit("4"), part(2, 15))
    digit = (10 - luhn_sum(F.concat(F.lit("5"), part(2, 14), F.lit("0"))) % 10) % 10
    right = F.concat(F.lit("5"), part(2, 14), digit.cast("string"))

    def some(least: int, more: int) -> Column:
        """Least to least + more - 1, by the seed."""
        return least + F.pmod(F.xxhash64(seed, F.lit(least)), F.lit(more)).cast("int")

    name = F.concat(F.substring(letters, F.lit(1), some(2, 6)), F.lit("."), F.substring(letters, F.lit(9), some(1, 7)))
    host = F.substring(letters, F.lit(17), some(3, 8))
    year = F.concat(F.lit("20"), part(1, 2))
    base64 = F.regexp_replace(F.base64(F.unhex(code)), "=", "")
    return [
        ("card", "", wrong),
        ("card", "card ", part(1, 16)),
        ("card", "", grouped(wrong, " ", 4, 4, 4, 4)),
        ("card", "account: ", grouped(right, ".", 4, 4, 4, 4)),
        ("card", "", grouped(right, "/", 4, 4, 4, 4)),
        ("card", "", grouped(part(1, 19), "-", 4, 4, 4, 4, 3)),
        ("phone", "call ", F.concat(F.lit("("), part(1, 3), F.lit(") "), part(4, 3), F.lit("-"), part(7, 4))),
        ("phone", "", grouped(part(1, 10), "-", 3, 3, 4)),
        ("phone", "", F.concat(F.lit("1 ("), part(1, 3), F.lit(") "), part(4, 3), F.lit("-"), part(7, 4))),
        ("phone", "tel: ", F.concat(F.lit("0"), grouped(part(1, 10), " ", 2, 8))),
        ("phone", "", F.concat(F.lit("0"), grouped(part(1, 9), "/", 2, 7))),
        ("phone", "fax ", grouped(part(1, 10), ".", 3, 3, 4)),
        ("phone", "", F.concat(F.lit("00"), grouped(part(1, 12), " ", 2, 3, 7))),
        ("email", "mail ", F.concat(name, F.lit(" (at) "), host, F.lit(" (dot) org"))),
        ("email", "", F.concat(name, part(1, 3), F.lit("[at]"), host, F.lit("-"), part(5, 1), F.lit(".net"))),
        ("email", "", F.concat(part(1, 1), name, part(2, 1), F.lit(" (at) "), part(3, 3), host, F.lit(" (dot) co (dot) uk"))),
        ("email", "", F.concat(name, F.lit(" [at] "), host, F.lit("[dot]com"))),
        ("email", "", F.concat(F.substring(letters, F.lit(1), some(4, 5)), F.lit("[at]"), host, F.lit(".de"))),
        ("secret", 'token = "', F.left(code, F.lit(40))),
        ("secret", "", F.left(code, some(28, 36))),
        ("secret", "key: ", F.left(base64, F.lit(40))),
        ("secret", "", base64),
        ("secret", "secret=", F.concat(F.lit("pk_"), F.left(base64, F.lit(24)))),
        (None, "on ", grouped(F.concat(year, F.lit("0"), part(3, 1), F.lit("1"), part(4, 1)), "-", 4, 2, 2)),
        (None, "", F.concat(F.lit("1"), part(1, 1), F.lit("/0"), part(2, 1), F.lit("/"), year, F.lit(" 1"), part(3, 1), F.lit("."), part(4, 2))),
        (None, "in ", F.concat(year, F.lit("-"), year, F.lit(" "), year)),
        (None, "costs $", F.concat(part(1, 1), F.lit("."), part(2, 3), F.lit("."), part(5, 3), F.lit("."), part(8, 3))),
        (None, "version ", grouped(part(1, 9), ".", 1, 2, 3, 3)),
        (None, "ISBN ", F.concat(F.lit("978-"), grouped(part(1, 10), "-", 1, 3, 5, 1))),
        (None, "ISBN ", F.concat(F.lit("979"), part(1, 10))),
        (None, "order ", F.substring(number, F.lit(1), some(7, 8))),
        (None, "item ", F.substring(number, F.lit(1), some(20, 16))),
        (None, "", part(1, 20)),
        (None, "", grouped(part(1, 30), " ", *[3] * 10)),
        (None, "", F.concat(F.substring(letters, F.lit(1), some(4, 5)), F.lit(" (at) "), part(1, 2), F.lit("."), part(3, 2))),
        (None, "", F.concat(F.substring(letters, F.lit(1), some(2, 6)), F.lit("[at]"), part(1, 1), F.lit(".pm"))),
        (None, "see ", F.concat(F.substring(letters, 1, 9), F.lit("_"), year, F.lit("_"), F.substring(letters, 11, 8))),
        (None, "", F.concat(F.substring(letters, 1, 14), F.lit("-"), part(1, 2), F.lit("-"), F.substring(letters, 15, 8))),
        (None, "", F.concat(F.lit("chapter"), part(1, 1), F.lit("_section"), part(2, 1))),
    ]


def planted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A snippet of each row with each variant in it: fold, id, text, of (kind), and the place of what was planted: from, upto."""
    own = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.filter(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), r"\s+"), lambda w: w != "").alias("words"))
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(kind).cast("string").alias("of"), F.lit(lead).alias("lead"), made.alias("made")) for k, (kind, lead, made) in enumerate(variants(F.col("id")))))
    rows = own.select("id", "words", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).alias("fold"), F.explode(each).alias("x")).select("id", "words", "fold", "x.*")
    rows = rows.withColumn("at", F.pmod(F.xxhash64("id", "k"), F.size("words") + 1).cast("int"))
    before = F.concat_ws(" ", F.slice("words", F.greatest(F.lit(1), F.col("at") - AROUND + 1), F.least(F.lit(AROUND), F.col("at"))), F.col("lead"))
    rows = rows.withColumn("before", before).withColumn("text", F.concat("before", "made", F.lit(" "), F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.lit(AROUND)))))
    return rows.select("id", "k", "fold", "of", "text", F.length("before").cast("long").alias("from"), (F.length("before") + F.length("made")).cast("long").alias("upto"))


def taught(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The labelled proposals of the planted snippets of docs: fold, kind, span, left, right, label."""
    snippets = planted(docs, id_col, text_col).withColumn("key", F.struct("id", "k", "fold", "of", "from", "upto"))
    rows = placed(proposals(snippets, "key", "text")).where(F.col("source").isin(*WIDE) & F.col("kind").isNotNull() & ~F.col("covered"))
    rows = rows.select("id.*", "kind", "start", "end", "span", "left", "right")
    just = (F.col("start") == F.col("from")) & (F.col("end") == F.col("upto"))
    meets = (F.col("start") < F.col("upto")) & (F.col("end") > F.col("from"))
    n = F.length(digits(F.col("span")))
    label = F.when(just & (F.col("kind") == F.col("of")), 1.0).when(meets | (F.col("kind").isin("card", "phone") & ~n.between(8, 19)), 0.0)
    labelled = rows.withColumn("label", label).where("label IS NOT NULL")
    # two generators may propose the same span as the same kind
    once = labelled.dropDuplicates(["id", "k", "start", "end", "kind"])
    return once.orderBy(F.xxhash64("id", "k", "start", "end", "kind"), "id", "k", "start", "end", "kind").limit(SAMPLE_SPANS).select("fold", "kind", "span", "left", "right", "label")


def fit_trees(data: DataFrame) -> tuple[Trees, DataFrame]:
    """Trees (without borders) of labelled proposals, and data with the features and the probability that the ML model itself gives."""
    made = features(F.col("span"), F.col("left"), F.col("right"), F.col("kind"))
    names = [f"f_{k}" for k in made]
    whole = VectorAssembler(inputCols=names, outputCol="features").transform(data.select("*", *made.values()))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(whole.where("fold > 0"))
    trees = Trees(names, [_nested(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights), {})
    return trees, model.transform(whole)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    """Trees and thresholds from a bounded sample of docs, or None where there is nothing to learn."""
    space = Workspace(docs.sparkSession, "pii")
    key = F.col(f"`{id_col}`")
    first = docs.where(key.isNotNull()).select(key.alias("picked")).distinct().orderBy(F.xxhash64("picked"), "picked").limit(SAMPLE_DOCS)
    sample = docs.join(F.broadcast(first), key == F.col("picked"), "left_semi")  # SAMPLE_DOCS ids at most
    data = space.keep(taught(sample, id_col, text_col).coalesce(1), "sample")
    if data.where("fold > 0").select("label").distinct().count() < 2:
        return None
    trees, scored = fit_trees(data)
    held = scored.where("fold = 0").select("kind", "label", trees.score({n: F.col(n) for n in trees.names}).alias("p"))
    by = Window.partitionBy("kind").orderBy(F.desc("p"))
    upto, below = by.rangeBetween(Window.unboundedPreceding, Window.currentRow), by.rowsBetween(1, Window.unboundedFollowing)
    told = held.withColumns({"share": F.avg("label").over(upto), "next": F.max("p").over(below)}).where(F.col("share") >= PRECISION)
    good = told.groupBy("kind").agg(F.min("p").alias("p"), F.min(F.coalesce("next", F.lit(0.0))).alias("next")).collect()
    space.drop("sample")
    # the middle of the gap below the last score that passes, and likelier than not by itself, too
    trees.borders = {r["kind"]: max(0.5, (r["p"] + r["next"]) / 2) for r in good}
    return trees


def best_apart(xs: Column) -> Column:
    """Of spans (p, kind, start, end), best first, those that overlap no better one that stays."""

    def add(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    kind = "array<struct<p:double,length:bigint,kind:int,start:bigint,end:bigint>>"
    return F.aggregate(F.reverse(F.array_sort(xs)), F.array().cast(kind), add)


def spans(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and two arrays of (kind number, start, end), sorted: base, and all (base and selected)."""
    rows = placed(proposals(docs, id_col, text_col))
    if trees is None:
        rows = rows.withColumn("p", F.lit(None).cast("double"))
    else:
        open_ = F.col("source").isin(*WIDE) & ~F.col("covered")
        rows = rows.withColumns({f"f_{k}": v for k, v in features(F.col("span"), F.col("left"), F.col("right"), F.col("kind")).items()})
        rows = rows.withColumn("p", F.when(open_, trees.score({n: F.col(n) for n in trees.names})))
        rows = rows.withColumn("p", F.when(F.col("p") >= trees.border(F.col("kind")), F.col("p")))
    number = (F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind")) - 1).cast("int")
    span = F.struct(number.alias("kind"), F.col("start"), F.col("end"))
    passed = F.struct("p", (F.col("end") - F.col("start")).cast("long").alias("length"), number.alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    # spans that overlap form a run, which begins where no earlier one reaches
    by = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max(F.when(F.col("p").isNotNull(), F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.when(F.col("p").isNotNull() & (F.coalesce(reach, F.lit(0)) <= F.col("start")), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = rows.groupBy("row", "id", "run").agg(F.collect_list(F.when(F.col("base"), span)).alias("base"), F.collect_list(F.when(F.col("p").isNotNull(), passed)).alias("passed"))
    added = F.transform(best_apart(F.col("passed")), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    out = runs.withColumn("added", F.when(F.size("passed") > 0, added).otherwise(F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))
    out = out.groupBy("row", "id").agg(F.flatten(F.collect_list("base")).alias("base"), F.flatten(F.collect_list("added")).alias("added"))
    return out.select(F.col("id").alias(id_col), F.array_sort("base").alias("base"), F.array_sort(F.array_union("base", "added")).alias("all"))


def redact(docs: DataFrame, trees: Trees | None, text_col: str = "text", mask: str = "*") -> DataFrame:
    """docs with the code points of all spans replaced by `mask`, spans that overlap too; rows are told by a number, so ids don't matter."""
    space = Workspace(docs.sparkSession, "redacted")
    rows = space.keep(docs.select(whole_row(docs), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("number")), "rows")
    found = spans(rows, trees, "number").select(F.col("number").alias("of"), F.array_sort(F.transform("all", lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))).alias("spans"))

    def hide(done: Column, s: Column) -> Column:
        """done: the text up to `at`, hidden."""
        first = F.greatest(done["at"], s["start"])
        clear = F.substring(F.col("text"), done["at"] + 1, first - done["at"])
        return F.struct(F.concat(done["out"], clear, F.repeat(F.lit(mask), F.greatest(F.lit(0), s["end"] - first))).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    hidden = F.aggregate("spans", start, hide, lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text"))))
    joined = rows.join(found, F.col("number") == F.col("of"))
    return joined.select(F.col("row").withField(f"`{text_col}`", F.when(F.size("spans") == 0, F.col("text")).otherwise(hidden)).alias("row")).select("row.*")
