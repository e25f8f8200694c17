"""Scoring a version against ground truth; merging two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ocrspark import pins
from ocrspark.functions.text import norm
from ocrspark.operators.spatial import overlap_join
from ocrspark.session import stack

PAGE = list(pins.PAGE_KEY)
ADDRESS = ("line_no", "word_no")
SIDE = (*ADDRESS, "word_id", "text", "conf")


def _side(words: DataFrame, p: str, keep: tuple[str, ...] = SIDE) -> DataFrame:
    """One word per page and box, columns prefixed.

    Partners are ranked by overlap, then by address. Of several words in the very same
    box only the first can be anyone's best partner, so the others cannot be paired and
    need not enter the join: a stack of copies costs one row instead of all its pairs.
    """
    first = F.min(F.struct(*keep)).alias("w")
    box = [F.col(s).alias(f"{p}{s}") for s in pins.BOX]
    return (
        words.groupBy(*PAGE, *pins.BOX)
        .agg(first)
        .select(*PAGE, *box, *[F.col(f"w.{s}").alias(f"{p}{s}") for s in keep])
    )


def align(
    gt: DataFrame, ocr: DataFrame, keep: tuple[str, ...] = SIDE, boxes: bool = False, page_levels: bool = False
) -> DataFrame:
    """One-to-one pairs of words on the same page: each is the best partner of the other.

    ``keep`` starts with the address of a word; fewer columns make smaller shuffles.
    ``page_levels`` is for versions stored by page (``sources.version_store``), here and below.
    """
    gt_side = _side(gt, "g_", keep)
    sizes = gt.select(*[F.col(s).alias(f"g_{s}") for s in pins.BOX])
    pairs = overlap_join(_side(ocr, "o_", keep), gt_side, "o_", "g_", page_levels=page_levels, sizes=sizes)
    best = [F.col("overlap").desc()]
    per_gt = W.partitionBy(*PAGE, "g_line_no", "g_word_no").orderBy(*best, "o_line_no", "o_word_no")
    per_ocr = W.partitionBy(*PAGE, "o_line_no", "o_word_no").orderBy(*best, "g_line_no", "g_word_no")
    if not boxes:
        pairs = pairs.drop(*[f"{p}{s}" for p in ("g_", "o_") for s in pins.BOX])
    return (
        pairs.withColumn("rg", F.row_number().over(per_gt))
        .withColumn("ro", F.row_number().over(per_ocr))
        .filter("rg = 1 and ro = 1")
        .drop("rg", "ro")
    )


def _same(punct: bool, cap: bool) -> Column:
    return norm(F.col("g_text"), punct, cap) == norm(F.col("o_text"), punct, cap)


def _with_rest(pairs: DataFrame, matched: Column, sides: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """A row ``matched`` per pair, and a row per address of ``sides`` that is in no pair.

    ``sides`` holds prefix, words and the row (a struct) of a word; of several words with one address the
    greatest row counts. The pairs are computed once: words of the first side are looked up in
    them, and what comes out meets the words of the second. All keys begin with the page, so rows that
    are dealt by document or page are not shuffled.
    """
    row_type = pairs.select(matched.alias("row")).schema["row"].dataType
    address = {p: [f"{p}{s}" for s in ADDRESS] for p, _, _ in sides}
    both = [c for names in address.values() for c in names]
    out = pairs.select(*PAGE, *both, matched.alias("row"), F.lit(True).alias("paired"))
    for p, words, row in sides:
        own = words.select(*[F.col(c).alias(f"_{c}") for c in (*PAGE, *ADDRESS)], row.cast(row_type).alias("lone"))
        own = own.groupBy(*[f"_{c}" for c in (*PAGE, *ADDRESS)]).agg(F.max("lone").alias("lone")).withColumn("known", F.lit(True))
        # an address may have nulls; a page has none where there is a pair
        same = [F.col(f"_{c}") == F.col(c) for c in PAGE] + [F.col("known") == F.col("paired")]
        same += [F.col(f"_{s}").eqNullSafe(F.col(c)) for s, c in zip(ADDRESS, address[p])]
        # every pair has a word of each side, so the first join loses none and keeps how its words are dealt
        first = p == sides[0][0]
        out = own.join(out, same, "left" if first else "full").select(
            *[F.col(f"_{c}").alias(c) if first else F.coalesce(f"_{c}", c).alias(c) for c in PAGE],
            *both, F.coalesce("row", "lone").alias("row"), "paired",
        )
    return out.select(*PAGE, "row.*")


def word_status(
    gt: DataFrame, ocr: DataFrame, ignore_punct: bool = True, ignore_cap: bool = True, page_levels: bool = False
) -> DataFrame:
    """Each ground-truth word as correct, incorrect or missed, and each extra word."""
    none, no_conf = F.lit(None).cast("string"), F.lit(None).cast("int")

    def row(p: str, gt_text: Column, ocr_text: Column, conf: Column, status: Column) -> Column:
        values = {"gt_text": gt_text, "ocr_text": ocr_text, "conf": conf, "status": status}
        address = [F.col(f"{p}{s}").alias(s) for s in ADDRESS]
        return F.struct(*address, *[v.alias(n) for n, v in values.items()])

    same = F.when(_same(ignore_punct, ignore_cap), "correct").otherwise("incorrect")
    text, conf = F.col("text"), F.col("conf")
    return _with_rest(
        align(gt, ocr, (*ADDRESS, "text", "conf"), page_levels=page_levels),
        row("g_", F.col("g_text"), F.col("o_text"), F.col("o_conf"), same),
        [
            ("g_", gt, row("", text, none, no_conf, F.lit("missed"))),
            ("o_", ocr, row("", none, text, conf, F.lit("extra"))),
        ],
    )


STATS = ("total", "correct", "incorrect", "missed", "extra", "correct_low_conf", "incorrect_high_conf")


def eval_page(status: DataFrame, conf_high: int = pins.CONF_HIGH) -> DataFrame:
    """Page statistics from word statuses."""
    is_ = lambda s: F.col("status") == s
    return status.groupBy(*PAGE).agg(
        F.count_if(~is_("extra")).alias("total"),
        *[F.count_if(is_(s)).alias(s) for s in ("correct", "incorrect", "missed", "extra")],
        F.count_if(is_("correct") & (F.col("conf") <= conf_high)).alias("correct_low_conf"),
        F.count_if(is_("incorrect") & (F.col("conf") > conf_high)).alias("incorrect_high_conf"),
    )


def eval_versions(
    gt: DataFrame,
    ocr: DataFrame,
    ignore_punct: bool = True,
    ignore_cap: bool = True,
    conf_high: int = pins.CONF_HIGH,
    page_levels: bool = False,
) -> DataFrame:
    """Page statistics of two versions, without listing the single words.

    Every pair uses up one word of each side, so missed and extra follow from plain
    counts and no word table has to be joined back to its pairs.
    """
    same = _same(ignore_punct, ignore_cap)
    high = F.col("o_conf") > conf_high
    zero = F.lit(0).cast("long")
    hits = align(gt, ocr, (*ADDRESS, "text", "conf"), page_levels=page_levels).groupBy(*PAGE).agg(
        zero.alias("total"), zero.alias("found"),
        F.count_if(same).alias("correct"),
        F.count_if(~same).alias("incorrect"),
        F.count_if(same & ~high).alias("correct_low_conf"),
        F.count_if(~same & high).alias("incorrect_high_conf"),
    )

    def counted(words: DataFrame, name: str) -> DataFrame:
        other = [c for c in hits.columns if c not in (*PAGE, name)]
        return words.groupBy(*PAGE).agg(F.count("*").alias(name), *[zero.alias(c) for c in other])

    rows = stack(hits, counted(gt, "total"), counted(ocr, "found"))
    sums = rows.groupBy(*PAGE).agg(*[F.sum(c).alias(c) for c in hits.columns if c not in PAGE])
    paired = F.col("correct") + F.col("incorrect")
    return (
        sums.withColumn("missed", F.col("total") - paired)
        .withColumn("extra", F.col("found") - paired)
        .select(*PAGE, *STATS)
    )


def eval_doc(page_stats: DataFrame) -> DataFrame:
    """Page, document and corpus totals in one pass; ``level`` is 0, 1 or 3."""
    return page_stats.rollup(*PAGE).agg(
        F.grouping_id().cast("int").alias("level"), *[F.sum(c).alias(c) for c in STATS]
    )


def wer(stats: DataFrame, ignore_extra: bool = False) -> DataFrame:
    """Word error rate; NULL where there are no words. ``wer_display`` has two decimals."""
    errors = F.col("incorrect") + F.col("missed")
    if not ignore_extra:
        errors = errors + F.col("extra")
    rate = F.try_divide(errors.cast("double"), F.col("total").cast("double"))
    return stats.withColumn("wer", rate).withColumn("wer_display", F.round("wer", 2))


WORD_COLS = (*ADDRESS, "word_id", "text", "conf", *pins.BOX)


def combine(a: DataFrame, b: DataFrame, mode: str = "data", page_levels: bool = False) -> DataFrame:
    """Merge two versions; ``source`` tells where a word comes from.

    ``data``: the more confident word of each pair (``a`` on a tie) and all words
    without a partner. ``conf``: the words of ``a``, with the greater confidence where
    both texts agree and the lesser one where they differ.
    """

    def row(source: Column, value) -> Column:
        return F.struct(*[value(c).alias(c) for c in WORD_COLS], source.alias("source"))

    def lone(p: str, words: DataFrame, source: str) -> tuple[str, DataFrame, Column]:
        return p, words, row(F.lit(source), F.col)

    pairs = align(a, b, boxes=True, page_levels=page_levels)
    if mode == "conf":
        agree = F.col("g_text") == F.col("o_text")
        conf = F.when(agree, F.greatest("g_conf", "o_conf")).otherwise(F.least("g_conf", "o_conf"))
        matched = row(F.lit("a"), lambda c: conf if c == "conf" else F.col(f"g_{c}"))
        return _with_rest(pairs, matched, [lone("g_", a, "a")])
    if mode != "data":
        raise ValueError(f"unknown combine mode: {mode!r}")
    from_b = F.col("o_conf") > F.col("g_conf")
    matched = row(
        F.when(from_b, "b").otherwise("a"),
        lambda c: F.when(from_b, F.col(f"o_{c}")).otherwise(F.col(f"g_{c}")),
    )
    return _with_rest(pairs, matched, [lone("g_", a, "a"), lone("o_", b, "b")])


def conflicts(
    a: DataFrame, b: DataFrame, ignore_punct: bool = True, ignore_cap: bool = True, page_levels: bool = False
) -> DataFrame:
    """Pairs of two versions whose texts differ."""
    return align(a, b, page_levels=page_levels).filter(~_same(ignore_punct, ignore_cap)).select(
        *PAGE, F.col("g_line_no").alias("line_no"), F.col("g_word_no").alias("word_no"),
        F.col("g_text").alias("a_text"), F.col("o_text").alias("b_text"),
        F.col("g_conf").alias("a_conf"), F.col("o_conf").alias("b_conf"),
    )
