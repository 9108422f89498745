"""Benchmark decontamination by a positional inverted index, in DataFrame operations alone.

Each window of a benchmark item (ten consecutive words, or all words of a shorter item) is searched by its rarest terms.
Terms are counted over the whole corpus; the postings ``(term, document, position)`` of each window's two rarest
terms are stored. A window's lists are intersected after each position is shifted by the term's place in the item, the
rarest term first; what survives both is compared word by word with the document. Terms that no window asks for
need no postings, so the index follows the benchmark's vocabulary, and no window can be missed: a window that
occurs has each of its terms at its place.

A proximity match is a stretch of words that becomes a whole window by ``CHANGES`` changes at most, each a word put in, left out
or changed. The window's words in twos from its start are pairs; a change breaks one pair at most, so one of the window's
``CHANGES + 1`` rarest pairs stands unbroken in the stretch. The index holds the places of such pairs; there
the window's words before and after the pair are compared with the text by edit distance. Exact matches of whole windows are proximity matches too. Windows of fewer words (whole short items) have
none: with so few words, likeness says little.

Null and blank texts have no words. Repeated rows and ids each keep their own hits (a row is known by its id and a hash of
id and text). A very long text is split where it is read, and its postings are rows like any others. Equally rare terms go by
name. Items without an id are searched too: they count in ``n_items``, all as one, and give no name to ``items``. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlace.llm.common import lower_ascii, only, stored

# Everything that is no word: ASCII but for digits and small letters, after A to Z are lowered.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, PROBES, SMALL, CELL, CHANGES = 10, 2, 100_000, 64, 2


def index_words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), BREAKS), ""), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``win, item, item_id string, at, words``: each window and its place in the item. ``item`` stands for an item with or
    without an id."""
    items = only(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), index_words(F.col("text")).alias("w")).where("size(w) > 0").distinct()
    places = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    wins = items.select(F.xxhash64("item_id", "w").alias("item"), "item_id", "w", F.explode(places).alias("at")).select("item", "item_id", "at", F.slice("w", F.col("at") + 1, F.lit(window)).alias("words"))
    return wins.select(F.xxhash64("item", "at", "words").alias("win"), "item", "item_id", "at", "words")


def _keyed(docs: DataFrame) -> DataFrame:
    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.withColumn("key", F.xxhash64("doc_id", "text"))


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``term, n``: occurrences of the vocabulary's terms in all documents; 0 where there is none. The join is
    Spark's to plan: it broadcasts the vocabulary only while its size is under the session's threshold."""
    words = _keyed(docs).select(F.explode(index_words(F.col("text"))).alias("term"))
    found = words.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return vocabulary.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def probes(windows: DataFrame, counts: DataFrame, n_probes: int = PROBES) -> DataFrame:
    """``win, item, item_id, at, term, off, k``: of each window its rarest terms, once each; k = 1 is the rarest."""
    each = windows.select("win", "item", "item_id", "at", F.posexplode("words").alias("off", "term")).join(counts, "term")
    once = each.groupBy("win", "item", "item_id", "at", "term", "n").agg(F.min("off").alias("off"))
    w = Window.partitionBy("win").orderBy("n", "term")
    return once.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n_probes).select("win", "item", "item_id", "at", "term", "off", "k")


def pairs(windows: DataFrame, counts: DataFrame, window: int = WINDOW, changes: int = CHANGES) -> DataFrame:
    """``win, item_id, words, pair, off``: the ``changes + 1`` rarest pairs of each whole window, those whose words'
    counts have the least product. ``pair`` is a hash of the two words and ``off`` the place of the first."""
    if changes + 1 > window // 2:
        raise ValueError("a window needs more pairs than changes")
    whole = windows.where(F.size("words") == window).select("win", "item_id", "words")
    starts = whole.withColumn("off", F.explode(F.array(*[F.lit(k) for k in range(0, window - 1, 2)])))
    named = starts.select("*", F.get("words", F.col("off")).alias("a"), F.get("words", F.col("off") + 1).alias("b"))
    known = named.join(counts.select(F.col("term").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("term").alias("b"), F.col("n").alias("nb")), "b")
    w = Window.partitionBy("win").orderBy((F.col("na").cast("double") * F.col("nb")), "off")
    rare = known.withColumn("k", F.row_number().over(w)).where(F.col("k") <= changes + 1)
    return rare.select("win", "item_id", "words", F.xxhash64("a", "b").alias("pair"), "off")


def postings(docs: DataFrame, terms: DataFrame, twos: DataFrame | None = None, window: int = WINDOW, changes: int = CHANGES) -> DataFrame:
    """``term, key, doc_id, pos, probe, pair, from, context``: the index, stored in the shared folder. ``terms`` are
    ``term, anchor``, the probes; ``twos`` are the hashes ``pair`` that count with the word after. A row is a place of either (``probe``, and
    ``pair`` if it is one of them). ``context`` has, for terms that are the rarest of a window and for pairs, the words
    around the place, from word ``from`` on, enough for any window that covers it with ``changes`` words more.
    Vocabularies of up to ``SMALL`` terms and pairs are broadcast; beyond, postings meet them in a shuffle and fetch their context
    afterwards. Only functions that Spark compiles are used up to the filter, else each word would carry a copy of its text."""
    text = _keyed(docs).select("key", "doc_id", index_words(F.col("text")).alias("w"))
    lo = F.greatest(F.lit(0), F.col("pos") - (window + changes))
    around = F.slice("w", F.col("from") + 1, F.lit(2 * (window + changes) + 1))
    single = terms.select("term", "anchor", F.lit(True).alias("probe"))
    each = text.select("key", "doc_id", "w", F.posexplode("w").alias("pos", "term"))
    each = each.select("*", (F.lit(0).cast("long") if twos is None else F.xxhash64("term", F.get("w", F.col("pos") + 1))).alias("here"))
    if terms.count() <= SMALL and (twos is None or twos.count() <= SMALL):
        met = each.join(F.broadcast(single), "term", "left")
        met = met.withColumn("pair", F.lit(None).cast("long")) if twos is None else met.join(F.broadcast(twos), F.col("here") == F.col("pair"), "left")
        met = met.where(F.col("probe") | F.col("pair").isNotNull())
    else:
        slim = each.drop("w")
        met = slim.join(single, "term").withColumn("pair", F.lit(None).cast("long"))
        if twos is not None:
            two = slim.join(twos, F.col("here") == F.col("pair")).select("*", F.lit(False).alias("probe"), F.lit(False).alias("anchor"))
            met = met.unionByName(two)
        met = met.join(text.dropDuplicates(["key"]).select("key", "w"), "key")
    out = met.withColumn("from", lo).select("term", "key", "doc_id", "pos", F.coalesce("probe", F.lit(False)).alias("probe"), "pair", "from", F.when(F.col("anchor") | F.col("pair").isNotNull(), around).alias("context"))
    return stored(out)


def phrase_matches(index: DataFrame, windows: DataFrame, probe: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key, doc_id, item_id, start, length``: the windows that occur. The list of each window's rarest term is shifted to
    where the item would begin; it is intersected with the shifted list of the next rarest; what both agree on is
    compared word by word with the rarest term's context. Terms of one window stand near each other in the item, so
    places meet by cells of ``CELL`` words of it: a long item that occurs whole costs rows in proportion to its length."""
    seat = (F.col("at") + F.col("off")).alias("seat")
    cell = lambda away: F.floor((F.col("seat") + away) / CELL)
    shift = F.xxhash64("key", "item", F.col("pos") - F.col("seat"), F.col("cell"))  # one number for the four; the words decide in the end
    first = probe.where("k = 1").select("term", "item", "at", seat)
    last = probe.where(f"k = {PROBES}").select("term", "item", "at", seat)
    # a window of one term repeated has no second list; its first stands in
    last = last.unionByName(first.join(last.select("item", "at"), ["item", "at"], "left_anti"))
    seats = lambda p: p.select("term", "item", "seat").distinct()
    index = index.where("probe")
    open_ = index.join(seats(first), "term").withColumn("cell", cell(0)).select(shift.alias("a"), "key", "doc_id", "item", (F.col("pos") - F.col("seat")).alias("delta"), F.col("seat").alias("s1"), "from", "context")
    met = index.join(seats(last), "term").withColumn("cell", F.explode(F.sequence(cell(1 - window), cell(window - 1)))).select(shift.alias("a"), F.col("seat").alias("s2"))
    two = first.select("item", "at", F.col("seat").alias("s1")).join(last.select("item", "at", F.col("seat").alias("s2")), ["item", "at"])
    want = stored(two.join(windows.select("item", "item_id", "at", "words"), ["item", "at"]).distinct())
    if want.count() <= SMALL:
        want = F.broadcast(want)
    cand = open_.join(met, "a").join(want, ["item", "s1", "s2"])
    start = F.col("delta") + F.col("at")
    same = F.slice("context", F.greatest(start - F.col("from"), F.lit(0)) + 1, F.size("words")) == F.col("words")
    return cand.where((start >= F.col("from")) & same).select("key", "doc_id", "item_id", start.alias("start"), F.size("words").alias("length")).distinct()


def proximity_matches(index: DataFrame, paired: DataFrame, changes: int = CHANGES) -> DataFrame:
    """``key, doc_id, item_id, changes``: the items of which a whole window occurs with ``changes`` changes at most, and
    the fewest. Each word around an unbroken pair becomes a letter, its place in the window, so edit distances of
    strings are those of words; what stands before the pair and what stands after it is compared by itself, over all
    lengths that so many changes allow."""
    near = index.where("pair is not null").select("key", "doc_id", "pair", "context", (F.col("pos") - F.col("from")).cast("int").alias("p"))
    paired = paired.select("item_id", "words", "pair", "off").distinct()
    if paired.count() <= SMALL:
        paired = F.broadcast(paired)
    letters = lambda words: F.array_join(F.transform(words, lambda x: F.char(F.lit(64) + F.array_position(F.col("words"), x))), "")
    same = [F.get("context", F.col("p") + k) == F.get("words", F.col("off") + k) for k in (0, 1)]  # the words decide, not the hash
    cand = near.join(paired, "pair").where(same[0] & same[1]).select("key", "doc_id", "item_id", "off", letters(F.col("context")).alias("c"), letters(F.col("words")).alias("w"), "p")
    before, after = F.substring("w", F.lit(1), F.col("off")), F.substring("w", F.col("off") + 3, F.length("w"))
    ahead, behind = [], []
    for d in range(-changes, changes + 1):
        lo = F.least(F.greatest(F.col("p") - F.col("off") + d, F.lit(0)), F.col("p"))
        ahead.append(F.levenshtein(before, F.substring("c", lo + 1, F.col("p") - lo)))
        behind.append(F.levenshtein(after, F.substring("c", F.col("p") + 3, F.greatest(F.length("w") - F.col("off") - 2 + d, F.lit(0)))))
    n = cand.select("key", "doc_id", "item_id", (F.least(*ahead) + F.least(*behind)).alias("n"))
    return n.where(F.col("n") <= changes).groupBy("key", "doc_id", "item_id").agg(F.min("n").alias("changes"))


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, changes: int | None = CHANGES) -> tuple[DataFrame, DataFrame | None]:
    """``exact phrase matches, proximity matches`` of the benchmark in the documents, both from one index, stored; without
    ``changes`` exact ones alone."""
    windows = stored(item_windows(benchmark, window))
    counts = stored(term_counts(docs, stored(windows.select(F.explode("words").alias("term")).distinct())))
    probe = stored(probes(windows, counts))
    paired = None if changes is None else stored(pairs(windows, counts, window, changes))
    terms = stored(probe.groupBy("term").agg((F.min("k") == 1).alias("anchor")))
    index = postings(docs, terms, None if paired is None else stored(paired.select("pair").distinct()), window, changes or 0)
    return stored(phrase_matches(index, windows, probe, window)), None if changes is None else stored(proximity_matches(index, paired, changes))


def _items(hits: DataFrame, items: str, nameless: str) -> DataFrame:
    """``_k, _i``, the named items met and whether one without an id was."""
    return hits.groupBy(F.col("key").alias("_k"), F.col("doc_id").alias("_i")).agg(F.sort_array(F.collect_set("item_id")).alias(items), F.max(F.col("item_id").isNull().cast("int")).alias(nameless))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, changes: int = CHANGES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated, n_near_items, near_items``, a row for each row of ``docs``. The
    last two are items with proximity matches, those with exact matches of whole windows among them; the others are exact."""
    hits, near = search(docs, benchmark, window, changes)
    words = hits.select("key", "doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("p")).distinct().groupBy("key", "doc_id").agg(F.count("*").alias("n_hit"))
    rows = _keyed(docs).select("key", "doc_id", F.size(index_words(F.col("text"))).cast("long").alias("n_words"))
    same = (F.col("key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_i"))
    found = words.join(_items(hits, "items", "nameless"), same).select("_k", "_i", "n_hit", "items", "nameless")
    out = rows.join(found, same, "left").drop("_k", "_i").join(_items(near, "near_items", "near_nameless"), same, "left")
    none, zero = F.array().cast("array<string>"), F.lit(0)
    for c in ("items", "near_items"):
        out = out.withColumn(c, F.coalesce(c, none))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).cast("long").alias("n_hit"), (F.size("items") + F.coalesce("nameless", zero)).cast("long").alias("n_items"), "items", (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        (F.size("near_items") + F.coalesce("near_nameless", zero)).cast("long").alias("n_near_items"), "near_items",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, changes: int | None = None) -> DataFrame:
    """The documents in which no window of the benchmark occurs, nor, if ``changes`` are given, a whole window with so many
    changes at most; columns as given."""
    exact, near = search(docs, benchmark, window, changes)
    hits = exact.select("key", "doc_id")
    if near is not None:
        hits = hits.unionByName(near.select("key", "doc_id"))
    hits = hits.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id")).distinct()
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    return docs.join(hits, (F.xxhash64(doc_id, text) == hits["_key"]) & doc_id.eqNullSafe(hits["_id"]), "left_anti")
