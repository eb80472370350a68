"""Pages made of repeated keywords, lists of links or product tags instead of sentences.

Each page's body is reduced to the counts of its words. Its rank-frequency curve is fitted with SQL windows: words in
order of falling frequency, words of equal frequency at their mean rank, a straight line through log frequency over
log rank. Repeated keywords make the line steep, bend it away (a large residual) or, where there are only a few of
them, lift it as a whole (a large mean log frequency, its height); sentences do none of it. The divergence of a page is
what of its words can't be explained by the prose of its language: each word is explained up to LEEWAY times its usual
frequency there, links (and all words of an item of a link list) and tags as one word each. All are held against the pages of the same language and of comparable
length (a factor of two), by medians and median deviations over all bodies, copies counted once.

A page is flagged if more than half of its words are unexplained and its curve is extreme, or its divergence is: more
than ALONE of its words are unexplained, which no deviation among pages of its length makes usual. Lines of
machine logs are neither sentences nor keywords: they count as part of the page only.

Models are statistics of all bodies: usual word frequencies of each language (each body with equal weight), and the
medians. Copies and near copies of a body count once in all of them, however many there are: else a page that is a
third of a corpus would pass for its prose. The model is fitted twice, the second time without the pages that the
first one flags. Words rarer than RARE in a language are left out of the model: the page loses LEEWAY * RARE for each
such word at most, and a language has at most 1 / RARE words, which bounds what is broadcast; a model of more than
MODEL_ROWS rows (very many languages) is joined instead.

Defined results: null, empty and blank texts and bodies without words have no curve and are never flagged. A page
without a language, or of one with fewer than MIN_PAGES bodies (too few to model), is compared with the language that
explains most of its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.mailtext import lines_of
from siltbed.session import balanced, broadcast_if_small, shared_path, ship, written

LEEWAY = 2.0
MIN_PAGES, RARE = 20, 2e-5
MODEL_ROWS = 2_000_000
FITS = 2
EXTREME = 2.0  #: median deviations beyond which a measure of the curve is extreme
ALONE = 0.75  #: share of unexplained words at which the divergence is extreme by itself
CURVE = ("slope", "residual", "height")
# Languages as they are spelled out, by their two letters.
SPELLED = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "fra": "fr", "fre": "fr", "french": "fr",
    "français": "fr", "spa": "es", "spanish": "es", "español": "es", "rus": "ru", "russian": "ru", "русский": "ru", "jpn": "ja",
    "japanese": "ja", "日本語": "ja", "ita": "it", "italian": "it", "por": "pt", "portuguese": "pt", "nld": "nl", "dut": "nl",
    "dutch": "nl", "pol": "pl", "polish": "pl", "zho": "zh", "chi": "zh", "chinese": "zh", "kor": "ko", "korean": "ko",
}

_LOG = re.compile(r"\b\d\d:\d\d:\d\d(?:[.,]\d+)?\s+(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b.*?(?=\s\d\d:\d\d:\d\d|\n|\Z)")
_URL = re.compile(r"https?://[^\s)\]>\"]+|www\.[^\s)\]>\"]+")
_WORD = re.compile(
    r"https?://[^\s)\]>\"]+|www\.[^\s)\]>\"]+|[#@][\w-]+|[\u3040-\u30ff\u3400-\u9fff]|[^\W_\u3040-\u30ff\u3400-\u9fff]+(?:['’@$.-]+[^\W_\u3040-\u30ff\u3400-\u9fff]+)*[@$]*|\$[\w@$.-]+"
)
_CODE = re.compile(r"[^\W\d_][\w]*-(?:\w+-)*\d+$")
# Digits and signs that stand for letters in disguised words.
_DISGUISE = str.maketrans("013457$@", "oieastsa")
URL, TAG, NUMBER, CODE = "<url>", "<tag>", "<number>", "<code>"


def _items(lines: list[str]) -> tuple[list[str], int]:
    """The lines without items of link lists, and the words of these: a line is one if links are over half of it."""
    kept, words = [], 0
    for line in lines:
        if "http" in line or "www." in line:
            if 2 * sum(len(x) for x in _URL.findall(line)) > len(line):
                words += len(_WORD.findall(line.lower()))
                continue
        kept.append(line)
    return kept, words


def words_of(lines: list[str]) -> tuple[Counter, int, int]:
    """(counts of words, links and tags among them, words in log lines). The words of a link list are all links."""
    lines, linked = _items(lines)
    text = "\n".join(lines)
    logged = 0
    if ":" in text:

        def drop(m: re.Match) -> str:
            nonlocal logged
            logged += len(m.group(0).split())
            return " "

        text = _LOG.sub(drop, text)
    counts = Counter(_WORD.findall(text.lower()))
    marks = linked
    for w in [w for w in counts if not w.isalpha()]:
        n = 0
        if w.startswith(("http", "www.")):
            kind, n = URL, counts[w]
        elif w[0] in "#@" and len(w) > 1:
            kind, n = TAG, counts[w]
        elif w.replace(".", "").isdigit():
            kind = NUMBER
        elif _CODE.match(w):
            kind, n = CODE, counts[w]
        else:
            plain = w.translate(_DISGUISE)
            if plain == w or not any(c.isalpha() for c in w):
                continue
            kind = plain
        marks += n
        counts[kind] += counts.pop(w)
    if linked:
        counts[URL] += linked
    return counts, marks, logged


def language(spelling: Column) -> Column:
    """The language of a spelling such as en, EN, en-GB, eng or English, else an empty string."""
    first = F.regexp_extract(F.lower(F.coalesce(spelling, F.lit(""))), r"^\s*([^\s_.-]*)", 1)
    known = F.create_map(*[F.lit(x) for pair in SPELLED.items() for x in pair])
    return F.coalesce(known[first], F.when(F.length(first).between(2, 3), first), F.lit(""))


def pages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a page: row, id, lang, n, marks, logged, words, counts, and its frequencies: freq, types."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        language(F.col(f"`{lang}`")).alias("lang"),
        F.col(f"`{text}`").alias("text"),
    ).filter(F.length(F.trim("text")) > 0)

    def reduce(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["n", "marks", "logged", "words", "counts", "freq", "types"]
        kinds = [pa.int32()] * 3 + [pa.list_(pa.string())] + [pa.list_(pa.int32())] * 3
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for t in b.column("text").to_pylist():
                counts, marks, logged = words_of(lines_of(t))
                spectrum = Counter(counts.values())
                row = (sum(counts.values()), marks, logged, list(counts), list(counts.values()), list(spectrum), list(spectrum.values()))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "id", "lang")], *arrays], names=["row", "id", "lang", *names])

    ints = "freq array<int>, types array<int>"
    return balanced(base).mapInArrow(
        reduce, f"row bigint, id {kind}, lang string, n int, marks int, logged int, words array<string>, counts array<int>, {ints}"
    )


def curves(p: DataFrame) -> DataFrame:
    """(row, slope, residual, height) of the rank-frequency curve of each page; the slope is null and the residual 0
    where all words are equally frequent."""
    steps = p.select("row", F.explode(F.arrays_zip("freq", "types")).alias("s")).select("row", "s.freq", "s.types")
    falling = Window.partitionBy("row").orderBy(F.col("freq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = steps.withColumn("upto", F.sum("types").over(falling))
    x, y, w = F.log(F.col("upto") - (F.col("types") - 1) / 2), F.log("freq"), F.col("types").cast("double")
    s = upto.groupBy("row").agg(
        F.sum(w).alias("w"),
        F.sum(w * x).alias("wx"),
        F.sum(w * y).alias("wy"),
        F.sum(w * x * x).alias("wxx"),
        F.sum(w * x * y).alias("wxy"),
        F.sum(w * y * y).alias("wyy"),
    )
    sxx = F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")
    sxy = F.col("wxy") - F.col("wx") * F.col("wy") / F.col("w")
    syy = F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w")
    slope = F.when(sxx > 1e-9, sxy / sxx)
    return s.select(
        "row", slope.alias("slope"), F.sqrt(F.greatest(F.lit(0.0), syy - slope * sxy) / F.col("w")).alias("residual"), (F.col("wy") / F.col("w")).alias("height")
    )


def with_body(p: DataFrame) -> DataFrame:
    """p with body: equal for copies, and for most pairs of pages that share nearly all words and their counts.

    It joins three of the extremes of the hashes of a page's (word, count) pairs, each of which two pages have in common
    as often as they have pairs in common; unrelated pages of one language hardly ever agree in all three.
    """
    hashes = F.transform(F.arrays_zip("words", "counts"), lambda x: F.xxhash64(x["words"], x["counts"]))
    third = F.array_min(F.transform("hashes", lambda h: h.bitwiseXOR(F.lit(1 << 62))))
    return p.withColumn("hashes", hashes).withColumn("body", F.xxhash64(F.array_min("hashes"), F.array_max("hashes"), third)).drop("hashes")


def one_each(p: DataFrame, *by: str) -> DataFrame:
    """(row): one page of each body among the pages that agree in by."""
    return p.groupBy(*by, "body").agg(F.min(F.struct("n", "row")).alias("b")).select("b.row")


def usual_words(fit: DataFrame) -> DataFrame:
    """(lang, word, p): usual frequencies of the words of each language with MIN_PAGES pages at least in fit; words rarer
    than RARE are left out."""
    fit = fit.filter(F.length("lang") > 0)
    sizes = fit.groupBy("lang").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    each = fit.select("lang", "n", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    mass = each.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum(F.col("x.counts") / F.col("n")).alias("mass"))
    p_ = mass.join(F.broadcast(sizes), "lang").select("lang", "word", (F.col("mass") / F.col("pages")).alias("p"))
    return p_.filter(F.col("p") >= RARE)


def explained(p: DataFrame, model: DataFrame, rows: int = MODEL_ROWS) -> DataFrame:
    """(row, like, share): the language that explains most of a page, and that share of its words; equal shares: the
    first language. like is null without any model. A model of at most `rows` rows is sent to all tasks."""
    if model.count() > rows:
        return explained_by_join(p, model)
    spark = p.sparkSession
    table = model.select("lang", "word", "p").toArrow().to_pandas().sort_values(["word", "lang"], ignore_index=True)
    langs = sorted(table["lang"].unique())
    words, at = np.unique(table["word"].to_numpy(object).astype(str), return_index=True) if len(table) else (np.empty(0, str), np.empty(0, int))
    order = table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(
        (langs, words.tolist(), at.astype(np.int64), np.diff([*at, len(table)]).astype(np.int64), order, table["p"].to_numpy(float) * LEEWAY)
    )

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        langs, words, first, length, lang, most = sent.value
        known = pa.array(words, pa.string())
        for b in batches:
            m = b.num_rows
            if not langs:
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.nulls(m, pa.string()), pa.array(np.zeros(m))], names=["row", "like", "share"])
                continue
            lists, counts = b.column("words"), b.column("counts")
            page = np.repeat(np.arange(m), np.asarray(pc.list_value_length(lists)))
            found = pc.index_in(lists.flatten(), known)
            on = np.asarray(found.is_valid())
            code = np.asarray(found.fill_null(0))[on].astype(np.int64)
            share = (np.asarray(counts.flatten()) / np.asarray(b.column("n"))[page])[on]
            # One entry for each language that uses the word.
            many = length[code]
            entry = np.repeat(first[code] - np.cumsum(many) + many, many) + np.arange(many.sum())
            got = np.bincount(
                np.repeat(page[on], many) * len(langs) + lang[entry], np.minimum(np.repeat(share, many), most[entry]), m * len(langs)
            ).astype(float).reshape(m, len(langs))
            best = got.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([langs[i] for i in best], pa.string()), pa.array(got[np.arange(m), best], pa.float64())], names=["row", "like", "share"]
            )

    return p.select("row", "n", "words", "counts").mapInArrow(compare, "row bigint, like string, share double")


def explained_by_join(p: DataFrame, model: DataFrame) -> DataFrame:
    """The same by a join on words, for a model of any size."""
    each = p.select("row", "n", F.explode(F.arrays_zip("words", "counts")).alias("x")).select(
        "row", F.col("x.words").alias("word"), (F.col("x.counts") / F.col("n")).alias("share")
    )
    by = each.join(model, "word").groupBy("row", "lang").agg(F.sum(F.least("share", F.col("p") * LEEWAY)).alias("share"))
    best = by.groupBy("row").agg(F.max_by("lang", F.struct(F.round("share", 9), _reversed("lang"))).alias("like"), F.max("share").alias("share"))
    none = model.agg(F.min("lang").alias("least"))
    return p.select("row").join(best, "row", "left").join(F.broadcast(none), F.lit(True), "left").select(
        "row", F.coalesce("like", "least").alias("like"), F.coalesce("share", F.lit(0.0)).alias("share")
    )


def _reversed(name: str) -> Column:
    """Orders strings of letters the other way round."""
    return F.transform(F.split(name, ""), lambda c: -F.ascii(c))


def with_medians(m: DataFrame, of: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """m with c_mid for each column c: its median over the pages of `of` that are like a page and of its size class, or
    over all pages like it where those are fewer than MIN_PAGES."""
    middle = lambda suffix: [F.percentile_approx(c, 0.5).alias(f"{c}_{suffix}") for c in columns]
    at = ["like", "size"]
    mid = of.groupBy(*at).agg(F.count(F.lit(1)).alias("pages"), *middle("mid")).filter(F.col("pages") >= MIN_PAGES).drop("pages")
    j = m.join(F.broadcast(mid), at, "left").join(F.broadcast(of.groupBy("like").agg(*middle("all"))), "like", "left")
    for c in columns:
        j = j.withColumn(f"{c}_mid", F.coalesce(f"{c}_mid", f"{c}_all")).drop(f"{c}_all")
    return j


def measures(docs: DataFrame, **columns: str) -> DataFrame:
    """All measures of each page with a curve, and whether it is stuffed."""
    base = shared_path(docs.sparkSession, "stuffing")
    p = written(with_body(pages(docs, **columns)), f"{base}/pages").filter("n > 0")
    shape = p.select("row", "id", "body", "lang", "n", "marks", "logged", F.floor(F.log2("n")).cast("int").alias("size")).join(curves(p), "row")
    firsts = written(one_each(p.filter(F.length("lang") > 0), "lang"), f"{base}/firsts")
    few = broadcast_if_small(firsts, f"{base}/firsts")
    shape = written(shape.join(few.withColumn("first", F.lit(True)), "row", "left"), f"{base}/shape")
    once = p.join(few, "row", "left_semi")
    fit, judged, bad = once, None, None
    for k in range(FITS):
        model = written(usual_words(fit), f"{base}/model={k}")
        m = shape.join(explained(p, model), "row")
        m = m.join(bad.withColumn("bad", F.lit(True)), "row", "left") if bad is not None else m.withColumn("bad", F.lit(None).cast("boolean"))
        judged = _judged(written(m, f"{base}/measures={k}"), f"{base}/fit={k}")
        if k + 1 < FITS:
            flagged = written(judged.filter("stuffed").select("row"), f"{base}/flagged={k}")
            bad = broadcast_if_small(flagged, f"{base}/flagged={k}")
            fit = once.join(bad, "row", "left_anti")
    return judged


def _judged(m: DataFrame, base: str) -> DataFrame:
    """m with the measures compared, and stuffed. Compared is with pages that say themselves that they are in the language
    they are like, each body once, and not flagged by the fit before: pages that are like no language are like some by
    chance, and would be that one's usual pages where it has few."""
    m = m.withColumn("first", F.col("first") & (F.col("lang") == F.col("like")) & F.col("bad").isNull())
    # All sides that are broadcast have at most one row for each language and size class.
    j = with_medians(m, m.filter("first"), ("share",))
    total = F.col("n") + F.col("logged")
    unexplained = (1 - F.least(F.lit(1.0), F.try_divide("share", "share_mid"))) * F.col("n") / total
    j = j.withColumn("unexplained", unexplained)
    prose = F.col("first") & (F.col("share") >= 0.5 * F.col("share_mid"))
    j = written(with_medians(j, j.filter(prose), CURVE), f"{base}/compared")
    off = lambda c: F.col(c) - F.col(f"{c}_mid")
    dev = lambda c: (1.4826 * F.percentile_approx(F.abs(off(c)), 0.5)).alias(f"{c}_dev")
    by_length = j.filter(prose).groupBy("like", "size").agg(dev("share"), F.count(F.lit(1)).alias("pages"))
    by_length = by_length.filter(F.col("pages") >= MIN_PAGES).drop("pages")
    j = j.join(F.broadcast(j.filter(prose).groupBy("like").agg(*map(dev, CURVE))), "like", "left").join(F.broadcast(by_length), ["like", "size"], "left")
    # Without pages of comparable length there is nothing to judge the divergence alone by.
    extreme = F.coalesce((F.col("unexplained") > ALONE) & (-off("share") > F.lit(EXTREME) * F.col("share_dev")), F.lit(False))
    for c in CURVE:
        side = -off(c) if c == "slope" else off(c)
        extreme = extreme | F.coalesce(side > F.lit(EXTREME) * F.col(f"{c}_dev"), F.lit(False))
    return j.withColumn("stuffed", F.coalesce((F.col("unexplained") > 0.5) & extreme, F.lit(False)))


def stuffed_pages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The ids of the stuffed pages, one row for each such row of docs."""
    m = measures(docs, id_col=id_col, text=text, lang=lang)
    return m.filter("stuffed").select(F.col("id").alias(id_col))
