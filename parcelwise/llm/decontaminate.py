"""Benchmark decontamination by template windows, with built-in functions only.

Numbers, names and units become typed placeholders, so a question whose parameters were changed keeps its
template. Windows of template words are hashed and joined with those of the benchmark; the values that stand in
the slots must then map one to one, as they do when a question was given new parameters. A capitalised word that
begins a sentence may be a name or not, so windows with such words have two templates, with the word and with a
placeholder. Windows of more placeholders than words are too loose a template and are joined word for word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.tables import kept

WIDTH = 8
COVERAGE = 0.5
SHORTEST = 4  # words of an item
BROADCAST_TEXTS = 2_000_000  # hashes of texts with a window of the benchmark, sent to all texts; more are joined
BROADCAST_WINDOWS = 1_000_000  # 50 MB at most; more windows are joined by a shuffle

# Private-use characters that mark words while the text is rewritten.
_POINT, _START, _NAME = "\ue000", "\ue001", "\ue002"
# Unit words that are placeholders behind a number.
UNITS = (
    "mm cm m km in inch inches ft feet yd yards mi mile miles mg g kg t lb lbs oz ml cl l litre litres liter liters "
    "gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents usd eur gbp hz khz mhz ghz kb mb gb tb w kw v a j kj kcal k c f "
    "degree degrees kmh mph"
).split()


def _marked(text: Column) -> Column:
    """A text's words between single spaces, without punctuation, names and first words of sentences marked."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[0-9])[.,:](?=[0-9])", _POINT)
    text = F.regexp_replace(text, r"(?:^|[.!?\n][^\p{L}\p{N}]*)(?=\p{Lu}\p{Ll})", f" {_START}")
    text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}{_START}])(?=\p{{Lu}}\p{{Ll}})", _NAME)
    return F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{_POINT}{_START}{_NAME}]+", " ")


def _split(marked: Column) -> Column:
    return F.array_remove(F.split(marked, " "), "")


def _is_number(word: Column) -> Column:
    return F.substring(word, 1, 1).between("0", "9")


# Codes of words end in two bits: whether the word is a slot, and whether it is the first of a sentence.
_FIRST, _SLOT, _CODE = 1, 2, ~3


def _code_of(kind: str) -> Column:
    return F.xxhash64(F.lit(kind)).bitwiseAND(F.lit(_CODE)).bitwiseOR(F.lit(_SLOT))


def _coded(df: DataFrame, *keys: str) -> DataFrame:
    """``words`` as they stand, ``codes`` of their template words with both bits, and ``plain`` codes of the words themselves."""
    df = df.select(*keys, _marked(F.col("text")).alias("marked"))
    lower = F.lower("marked")
    df = df.select(
        *keys, _split(F.col("marked")).alias("words"), _split(lower).alias("low"), _split(F.translate(lower, _START + _NAME, "")).alias("bare")
    )

    def code(word: Column, i: Column) -> Column:
        mark = F.substring(word, 1, 1)
        known = lambda w: w.isin(UNITS) & F.coalesce(_is_number(F.get("low", i - 1)), F.lit(False))
        own = lambda w: F.when(known(w), _code_of("#unit")).otherwise(F.xxhash64(w).bitwiseAND(F.lit(_CODE)))
        return (
            F.when(mark.between("0", "9"), _code_of("#number"))
            .when(mark == _NAME, _code_of("#name"))
            .when(mark == _START, own(F.substring(word, 2, 1_000_000)).bitwiseOR(F.lit(_FIRST)))
            .otherwise(own(word))
        )

    return df.select(
        *keys, "words", F.transform("low", code).alias("codes"), F.transform("bare", lambda w: F.xxhash64(w)).alias("plain")
    )


def _strict(code: Column) -> Column:
    return code.bitwiseAND(F.lit(~_FIRST))


def _loose(code: Column) -> Column:
    return F.when(code.bitwiseAND(F.lit(_FIRST)) != 0, _code_of("#name")).otherwise(code)


def _window_code(width: int, codes: list[Column]) -> Column:
    return F.xxhash64(F.lit(width), *codes[:width])


def _benchmark_windows(items: DataFrame, width: int) -> DataFrame:
    """Rows for each window of each item, with its slots' values: one for each template that is half literal words
    at least; if there is none, one for the words themselves, without slots.

    An item of fewer words than a window is one window of its own length, of fewer than ``SHORTEST`` none.
    """
    items = _coded(items.where("item_id IS NOT NULL"), "item_id").where(F.size("words") >= min(SHORTEST, width))
    own = F.least(F.lit(width), F.size("words"))
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - own))
    windows = items.select("*", own.alias("width"), starts.alias("at"))
    kinds = F.create_map(*(x for kind in ("#number", "#name", "#unit") for x in (_code_of(kind), F.lit(kind))))

    def slots(of) -> Column:
        each = F.transform(
            F.slice("codes", F.col("at") + 1, F.col("width")),
            lambda c, j: F.when(
                of(c).bitwiseAND(F.lit(_SLOT)) != 0,
                F.struct(F.element_at(kinds, of(c)).alias("kind"), j.alias("j"), _value(F.col("at") + j).alias("value")),
            ),
        )
        return F.filter(each, lambda s: s.isNotNull())

    def code(array: str, of) -> Column:
        """By width, as the hash takes a fixed number of codes."""
        each = [of(F.get(array, F.col("at") + j)) for j in range(width)]
        return F.coalesce(*(F.when(F.col("width") == w, _window_code(w, each)) for w in range(1, width + 1)))

    windows = windows.withColumn("strict", slots(_strict)).withColumn("loose", slots(_loose))
    windows = windows.withColumn("light", F.size("strict") * 2 <= F.col("width"))
    rows = [
        windows.where(wanted).select("item_id", "width", "at", "light", F.lit(variant).alias("variant"), code(array, of).alias("code"), own_slots.alias("slots"))
        for variant, array, of, own_slots, wanted in (
            ("strict", "codes", _strict, F.col("strict"), F.col("light")),
            ("loose", "codes", _loose, F.col("loose"), (F.size("loose") * 2 <= F.col("width")) & (F.size("loose") > F.size("strict"))),
            ("plain", "plain", lambda c: c, F.slice("strict", 1, 0), ~F.col("light")),
        )
    ]
    rows = reduce(DataFrame.unionByName, rows)
    totals = rows.groupBy("item_id").agg(
        F.count_distinct("at").alias("n_windows"), F.count_distinct(F.when(F.col("light"), F.col("at"))).alias("n_light")
    )
    return rows.distinct().join(totals, "item_id")


def _document_windows(docs: DataFrame, keys: tuple[str, ...], wanted: set[tuple[int, str]], width: int) -> DataFrame:
    """``keys``, ``text_hash``, ``pos``, ``code`` of the windows of the documents, of all widths in one pass.

    Texts stay behind, so that a row of a window is short. Words are laid beside those behind them and exploded, so that a window is a row and its codes are built by generated code. Its second
    template is built only where it has the first word of a sentence.
    """
    arrays = {"codes": {v for _, v in wanted} & {"strict", "loose"}, "plain": {v for _, v in wanted} & {"plain"}}
    names = [(a, j) for a, used in arrays.items() if used for j in range(width)]
    coded = _coded(docs, *keys, "text_hash")
    if not names:
        return coded.select(*keys, "text_hash", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("code")).limit(0)
    shifted = [F.col(a) if j == 0 else F.slice(a, F.lit(j + 1), F.greatest(F.size(a) - j, F.lit(0))) for a, j in names]
    zipped = F.arrays_zip(*(x.alias(f"{a}{j}") for x, (a, j) in zip(shifted, names, strict=True)))
    rows = coded.select(*keys, "text_hash", F.posexplode(zipped).alias("pos", "w"))
    each = {a: [F.col(f"w.{a}{j}") for j in range(width)] for a, used in arrays.items() if used}
    found = []
    for own, variant in sorted(wanted):
        if variant == "plain":
            codes, here = each["plain"], F.lit(True)
        else:
            codes = [(_strict if variant == "strict" else _loose)(c) for c in each["codes"]]
            flags = reduce(Column.bitwiseOR, each["codes"][:own])
            here = F.lit(True) if variant == "strict" else flags.bitwiseAND(F.lit(_FIRST)) != 0
        whole = each["plain" if variant == "plain" else "codes"][own - 1].isNotNull()
        found.append(F.when(whole & here, _window_code(own, codes)))
    return rows.select(*keys, "text_hash", "pos", F.explode(F.array(*found)).alias("code")).where("code IS NOT NULL")


def short_items(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The items that decontamination leaves out, with an id and fewer than ``SHORTEST`` words: they stand in clean texts by chance."""
    words = _split(_marked(F.col("text")))
    return items.where(F.col("item_id").isNotNull() & (F.size(words) < min(SHORTEST, width)))


def _value(at: Column) -> Column:
    """The word at a place, without marks."""
    return F.ltrim(F.get("words", at), F.lit(_START + _NAME))


def _one_to_one(pairs: Column) -> Column:
    """Whether no two values of one side stand for one value of the other."""
    distinct = F.size(F.array_distinct(pairs))
    left = F.array_distinct(F.transform(pairs, lambda p: F.struct(p["kind"], p["item_value"])))
    right = F.array_distinct(F.transform(pairs, lambda p: F.struct(p["kind"], p["doc_value"])))
    return (distinct == F.size(left)) & (distinct == F.size(right))


def contaminated(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, keys: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The documents that hold a benchmark item, one row for each document and item.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``. An item is held if windows at
    one distance to its own, whose slot values map one to one, cover ``coverage`` of its windows, over all
    such distances together. ``n_changed`` counts slots with another value than the benchmark's; the row is
    ``reparameterised`` if there are any.

    A name may stand anywhere, at the start of a sentence too. Windows with more slots than words count if they are
    repeated word for word, other than by case. Since no new parameters can do that, coverage is the larger of the
    shares of all windows and of the others.

    Items of fewer than ``SHORTEST`` words are left out, as :func:`short_items` lists: their words stand in clean texts too. Shorter
    ones than a window are held if their words follow each other anywhere. Texts are read whole.

    Null and empty texts hold nothing and are held nowhere; an item without id is left out, a document
    without id is reported under null. Items and documents that repeat count once per id. Empty tables give no
    rows; other columns are ignored.
    """
    windows = _benchmark_windows(items.select("item_id", "text"), width)
    kinds = windows.groupBy("width", "variant").count().collect()  # at most three rows for each width up to ``width``
    wanted = {(r["width"], r["variant"]) for r in kinds} | {(w, "strict") for w in {r["width"] for r in kinds}}
    wanted |= {(w, "loose") for w, v in wanted if v == "strict"}
    bounded = sum(r["count"] for r in kinds) <= BROADCAST_WINDOWS
    docs = docs.select(*keys, "text", F.xxhash64("text").alias("text_hash"))
    hits = _document_windows(docs, keys, wanted, width).join(F.broadcast(windows) if bounded else windows, "code")
    hits = kept(hits.distinct(), "hits")
    held = hits.select("text_hash").distinct()
    if held.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        held = F.broadcast(held)
    texts = docs.join(held, "text_hash", "left_semi").distinct().select(*keys, "text_hash", _split(_marked(F.col("text"))).alias("words"))
    same = reduce(Column.__and__, (hits[k].eqNullSafe(texts[k]) for k in (*keys, "text_hash")))
    hits = hits.join(texts, same).select(*(hits[c] for c in hits.columns), "words")
    value = lambda s: F.struct(
        s["kind"].alias("kind"),
        (F.col("at") + s["j"]).alias("at"),
        s["value"].alias("item_value"),
        _value(F.col("pos") + s["j"]).alias("doc_value"),
    )
    place = ("item_id", "n_windows", "n_light")
    found = hits.select(
        *keys,
        *place,
        F.struct("at", "light").alias("window"),
        (F.col("variant") != "loose").alias("literal"),
        (F.col("pos") - F.col("at")).alias("shift"),
        F.transform("slots", value).alias("pairs"),
    )
    strict = lambda c: F.when(F.col("literal"), F.col(c))
    placed = found.groupBy(*keys, *place, "shift").agg(
        F.collect_set("window").alias("ats"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
        F.collect_set(strict("window")).alias("strict_ats"),
        F.array_distinct(F.flatten(F.collect_list(strict("pairs")))).alias("strict_pairs"),
    )

    def consistent(pairs: str) -> Column:
        return _one_to_one(
            F.transform(pairs, lambda p: F.struct(p["kind"].alias("kind"), p["item_value"].alias("item_value"), p["doc_value"].alias("doc_value")))
        )

    # First words that do not map one to one as names are words.
    placed = (
        placed.withColumn("every", consistent("pairs"))
        .where(F.col("every") | consistent("strict_pairs") & (F.size("strict_ats") > 0))
        .withColumn("ats", F.when(F.col("every"), F.col("ats")).otherwise(F.col("strict_ats")))
        .withColumn("pairs", F.when(F.col("every"), F.col("pairs")).otherwise(F.col("strict_pairs")))
        .withColumn("changed", F.size(F.filter("pairs", lambda p: ~p["item_value"].eqNullSafe(p["doc_value"]))))
    )
    matched = F.col("matched")
    n_light = F.size(F.filter(matched, lambda m: m["light"]))
    share = F.greatest(F.size(matched) / F.col("n_windows"), F.when(F.col("n_light") > 0, n_light / F.col("n_light")))
    return (
        placed.groupBy(*keys, *place)
        .agg(
            F.array_distinct(F.flatten(F.collect_list("ats"))).alias("matched"),
            F.min("changed").cast("long").alias("n_changed"),
        )
        .withColumn("n_matched", F.size(matched).cast("long"))
        .withColumn("coverage", share)
        .where(F.col("coverage") >= coverage)
        .withColumn("reparameterised", F.col("n_changed") > 0)
        .select(*keys, "item_id", "n_windows", "n_matched", "n_changed", "coverage", "reparameterised")
    )


def without_benchmark(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay, other rows are untouched."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    held = contaminated(keyed, items, keys=("doc_id", "text_key"), **options).select(
        F.col("doc_id").alias("held_id"), F.col("text_key").alias("held_key")
    ).distinct()
    same = docs["doc_id"].eqNullSafe(held["held_id"]) & (F.xxhash64(docs["text"]) == held["held_key"])
    return docs.join(held, same, "left_anti")
