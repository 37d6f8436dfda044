"""Surface index, dictionary and fuzzy joins, retrieval of facts, and the validator that uses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import greedy
from ..functions.text import has_alphanumeric, normalize_mention, normalize_tokens
from .grams import closest, trigram_codes
from .prefix import frequencies, prefix, rare_first
from .trie import matcher, token_hashes


def windows(sentences: DataFrame, longest: int = 6, *keep: str, shortest: int = 1) -> DataFrame:
    """All token windows of ``shortest`` to ``longest`` tokens: sid, s, e, key. Windows without a letter or digit are left out."""
    rows = sentences.select("sid", *keep, normalize_tokens(F.col("tokens")).alias("t")).where(F.size("t") >= shortest)
    # the windows of a start are made inside the row, so an exploded row holds a key and never the sentence
    starts = F.sequence(F.lit(0), F.size("t") - shortest)
    made = F.flatten(
        F.transform(
            starts,
            lambda s: F.transform(F.sequence(s + shortest, F.least(s + longest, F.size("t"))), lambda e: F.struct(s.alias("s"), e.alias("e"), F.array_join(F.slice("t", s + 1, e - s), " ").alias("key"))),
        )
    )
    return rows.select("sid", *keep, F.inline(made)).where(has_alphanumeric(F.col("key")))


def surface_index(spans: DataFrame, sentences: DataFrame | None = None, longest: int = 6, most_tokens: int = 18) -> DataFrame:
    """key, label (first seen), types map<string,bigint>, first (type -> first position), total, o (occurrences outside spans).

    spans: sid, s, e, type, surface, pos (order of first appearance). Two aggregations on (key, type) and key; occurrences
    come from a dictionary join of the texts less those that are spans.
    """
    kept = spans.where(F.col("e") - F.col("s") <= most_tokens).withColumn("key", normalize_mention(F.col("surface")))
    per = kept.groupBy("key", "type").agg(F.count("*").alias("n"), F.min(F.struct("pos", "surface")).alias("at"))
    index = per.groupBy("key").agg(
        F.min("at")["surface"].alias("label"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", F.col("at.pos").alias("pos"))))).alias("first"),
        F.sum("n").alias("total"),
    )
    if sentences is None:
        return index.withColumn("o", F.lit(0).cast("long"))
    everywhere = dictionary_counts(sentences, index.select("key"), longest)
    # hits that are spans are looked for in the texts that have spans
    marked = spans.select("sid").distinct()
    marked = F.broadcast(marked) if marked.count() <= 1 << 20 else marked
    found = dictionary_join(sentences.join(marked, "sid", "left_semi"), index.select("key"), longest)
    inside = found.join(spans.select("sid", "s", "e").distinct(), ["sid", "s", "e"]).groupBy("key").agg(F.count("*").alias("__in"))
    rows = index.join(everywhere, "key", "left").join(inside, "key", "left")
    return rows.select(*index.columns, (F.coalesce("n", F.lit(0)) - F.coalesce("__in", F.lit(0))).alias("o"))


def merge_indexes(index: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Both indexes by key; where they collide the synthetic types stay apart in ``synthetic_types``."""
    s = synthetic.select("key", *[F.col(c).alias(f"s_{c}") for c in ("label", "types", "total", "o")])
    both = index.select("key", "label", "types", "total", "o").join(s, "key", "full")
    return both.select(
        "key", *[F.coalesce(c, F.col(f"s_{c}")).alias(c) for c in ("label", "types", "total", "o")], F.when(F.col("label").isNotNull(), F.col("s_types")).alias("synthetic_types"), F.when(F.col("label").isNull(), "synthetic").otherwise("train").alias("origin")
    )


def best_type(types: Column, first: Column | None = None) -> Column:
    """The commonest type; ties go to the one seen first, or by name where that isn't known."""
    entries = F.transform(F.map_entries(types), lambda x: F.struct((-x["value"]).alias("n"), (F.element_at(first, x["key"]) if first is not None else F.lit(0)).alias("p"), x["key"].alias("t"), x["value"].alias("c")))
    return F.array_min(entries)


def gazetteer(index: DataFrame, least: int = 2, purity: float = 0.9, most_outside: float = 0.5) -> DataFrame:
    """key, type of entries that are safe to tag: often enough, of one type, rarely outside mentions."""
    best = best_type(F.col("types"), F.col("first"))
    return index.where((F.col("total") >= least) & (best["c"] >= purity * F.col("total")) & (F.col("o") < most_outside * (F.col("o") + F.col("total")))).select("key", best["t"].alias("type"))


def dictionary_join(sentences: DataFrame, entries: DataFrame, longest: int = 6, shortest: int = 1, *, most_tokens: int = 1 << 22) -> DataFrame:
    """Windows whose key is an entry's: sid, s, e, key and the entry's columns.

    An entry's key is its normalised tokens joined by single spaces. Dictionaries of up to ``most_tokens`` tokens are broadcast as a trie, which
    finds the windows inside each row; larger ones meet all windows by a shuffled join on hashes. In both ways the windows' texts are
    compared with the keys, so a collision of hashes is no hit.
    """
    rows = sentences.select("sid", normalize_tokens(F.col("tokens")).alias("t"))
    held = _of_length(entries, shortest, longest)
    keys = held.select("key", token_hashes(F.col("__t")).alias("__t")).distinct()
    if (keys.agg(F.sum(F.size("__t"))).first()[0] or 0) <= most_tokens:
        hits = rows.withColumn("w", matcher(keys, "__t")(token_hashes(F.col("t")))).select("sid", F.inline(_windows_at(F.col("w"))))
        return hits.join(held.drop("__t"), "key").select("sid", "s", "e", *entries.columns)

    def of(n: int) -> Column:
        starts = F.when(F.size("t") >= n, F.sequence(F.lit(0), F.size("t") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("s"), (i + n).alias("e"), F.xxhash64(F.slice("t", i + 1, n)).alias("__h"), F.array_join(F.slice("t", i + 1, n), " ").alias("__k")))

    made = F.concat(*[of(n) for n in range(shortest, longest + 1)]) if longest > shortest else of(longest)
    held = held.withColumn("__h", F.xxhash64("__t")).drop("__t")
    return rows.select("sid", F.inline(made)).join(held, "__h").where("__k = key").select("sid", "s", "e", *entries.columns)


def _of_length(entries: DataFrame, shortest: int, longest: int) -> DataFrame:
    return entries.where(has_alphanumeric(F.col("key"))).withColumn("__t", F.split("key", " ")).where(F.size("__t").between(shortest, longest))


def _windows_at(places: Column) -> Column:
    """s, e, key of the places of a row's tokens ``t``, made inside the row: an exploded row holds a key and never the tokens."""
    return F.transform(places, lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), F.array_join(F.slice("t", w["s"] + 1, w["e"] - w["s"]), " ").alias("key")))


def dictionary_counts(sentences: DataFrame, entries: DataFrame, longest: int = 6, shortest: int = 1, *, most_tokens: int = 1 << 22) -> DataFrame:
    """key, n: how many windows of the sentences are each entry (key). As :func:`dictionary_join`, but windows are counted before they are shuffled."""
    held = _of_length(entries.select("key").distinct(), shortest, longest)
    keys = held.select("key", token_hashes(F.col("__t")).alias("__t"))
    if (keys.agg(F.sum(F.size("__t"))).first()[0] or 0) > most_tokens:
        return dictionary_join(sentences, entries.select("key").distinct(), longest, shortest, most_tokens=most_tokens).groupBy("key").agg(F.count("*").alias("n"))
    rows = sentences.select(normalize_tokens(F.col("tokens")).alias("t"))
    found = rows.select(F.explode(F.transform(_windows_at(matcher(keys, "__t")(token_hashes(F.col("t")))), lambda x: x["key"])).alias("key"))
    return found.groupBy("key").agg(F.count("*").alias("n")).join(held.select("key"), "key", "left_semi")


def gazetteer_spans(sentences: DataFrame, entries: DataFrame, longest: int = 6) -> DataFrame:
    """sid, spans: greedy matches, longest first."""
    from ..functions.spans import non_overlapping

    hits = dictionary_join(sentences, entries, longest).groupBy("sid").agg(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), "type")).alias("c"))
    return hits.select("sid", non_overlapping(F.col("c")).alias("spans"))


def trigram_join(queries: DataFrame, keys: DataFrame, least: float = 0.5, shortest: int = 5, *, most_trigrams: int = 1 << 18) -> DataFrame:
    """q, key, similarity: for each query text the key with the largest trigram Jaccard similarity of at least ``least``; ties by key.

    Queries of up to ``most_trigrams`` trigrams in all are broadcast, and a key's shared trigrams with all of them are counted inside its row. More of
    them meet the keys by their rarest trigrams: sizes and the places of the first shared trigram bound what can be shared before whole sets
    are compared. Rows of that join hold digests and numbers, never texts or sets.
    """
    asked = queries.select("q").where("q IS NOT NULL").distinct()
    held = keys.select("key").distinct().where(F.length("key") >= shortest)
    found = closest(asked, keys.select("key").where(F.length("key") >= shortest), least) if (asked.agg(F.sum(F.length("q") + 1)).first()[0] or 0) <= most_trigrams else _closest_by_prefix(asked, held, least)
    return found.groupBy("q").agg(F.min(F.struct(-F.col("similarity"), "key", "similarity")).alias("best")).select("q", "best.key", "best.similarity")


def _closest_by_prefix(asked: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """q, key, similarity of all pairs with at least ``least``, by an exact prefix filter."""
    codes = trigram_codes()
    sides = {name: rows.select(F.md5(name).alias(f"__{name}"), codes(F.col(name)).alias("t")) for name, rows in (("q", asked), ("key", held))}
    frequency = frequencies(sides["key"], F.col("t"))
    parts, sets = [], []
    for name, rows in sides.items():
        made = rare_first(rows, f"__{name}", F.col("t"), frequency).select(f"__{name}", "tokens", F.size("tokens").alias(f"n_{name}"))
        parts.append(made.select(f"__{name}", f"n_{name}", F.posexplode(prefix(F.col("tokens"), F.size("tokens") * least)).alias(f"at_{name}", "token")))
        sets.append(made.select(f"__{name}", F.col("tokens").alias(f"t_{name}")))
    nq, nk = F.col("n_q"), F.col("n_key")
    met = parts[0].join(parts[1], "token").where((nk >= least * nq) & (nq >= least * nk))
    met = met.groupBy("__q", "__key", "n_q", "n_key").agg(F.min("at_q").alias("at_q"), F.min("at_key").alias("at_key"))
    met = met.where(F.least(nq - F.col("at_q"), nk - F.col("at_key")) >= (nq + nk) * (least / (1 + least)) - 1e-9)
    pairs = met.join(sets[0], "__q").join(sets[1], "__key").withColumn("n", F.size(F.array_intersect("t_q", "t_key")))
    pairs = pairs.select("__q", "__key", (F.col("n").cast("double") / (nq + nk - F.col("n"))).alias("similarity")).where(F.col("similarity") >= least)
    return pairs.join(asked.withColumn("__q", F.md5("q")), "__q").join(held.withColumn("__key", F.md5("key")), "__key").select("q", "key", "similarity")


def retrieve_facts(sentences: DataFrame, index: DataFrame, most: int = 10, longest: int = 6, fuzzy: float | None = None) -> DataFrame:
    """sid, facts: non-overlapping index entries that a sentence mentions, best first by (length, similarity, count, purity), returned by start.

    Keys without an exact entry are tried by trigrams if they have up to three tokens and six characters.
    """
    entries = index.select("key", "types", "total", "o")
    hits = dictionary_join(sentences, entries, longest).select("sid", "s", "e", F.col("key").alias("entry"), "types", "total", "o", F.lit(1.0).alias("similarity"))
    if fuzzy is not None:
        rest = windows(sentences, longest).where((F.col("e") - F.col("s") <= 3) & (F.length("key") >= 6)).join(entries.select("key"), "key", "left_anti")
        near = trigram_join(rest.select(F.col("key").alias("q")), entries, fuzzy).withColumnRenamed("key", "entry")
        hits = hits.union(rest.withColumnRenamed("key", "q").join(near, "q").join(entries.withColumnRenamed("key", "entry"), "entry").select("sid", "s", "e", "entry", "types", "total", "o", "similarity"))
    purity = F.array_max(F.map_values("types")) / F.col("total")
    fact = F.struct((F.col("s") - F.col("e")).alias("k0"), (-F.col("similarity")).alias("k1"), (-F.col("total")).alias("k2"), (-purity).alias("k3"), F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), "entry", "similarity", "total", "o")
    kind = "array<struct<k0:int,k1:double,k2:bigint,k3:double,s:int,e:int,entry:string,similarity:double,total:bigint,o:bigint>>"
    chosen = greedy(F.array_sort(F.collect_list(fact)).cast(kind), most, kind)
    out = hits.groupBy("sid").agg(chosen.alias("c"))
    return out.select("sid", F.array_sort(F.transform("c", lambda x: F.struct(*[x[n].alias(n) for n in ("s", "e", "entry", "similarity", "total", "o")]))).alias("facts"))


def validate_spans(pred: DataFrame, index: DataFrame, *, retype_purity: float = 0.9, retype_least: int = 3, drop_ratio: float = 0.9, drop_least: int = 5) -> DataFrame:
    """Predicted spans (sid, s, e, type, surface) with ``action`` (keep, drop or retype) and ``new_type`` (null if dropped).

    An entry that occurs mostly outside mentions drops the span; one that is almost always of another type retypes it.
    """
    entries = index.select("key", "types", "first", "total", "o")
    rows = pred.withColumn("key", normalize_mention(F.col("surface"))).join(entries, "key", "left")
    best = best_type(F.col("types"), F.col("first"))
    seen = F.col("o") + F.col("total")
    drop = (seen >= drop_least) & (F.col("o") >= drop_ratio * seen)
    retype = (best["t"] != F.col("type")) & (F.col("total") >= retype_least) & (best["c"] >= retype_purity * F.col("total"))
    action = F.when(drop, "drop").when(retype, "retype").otherwise("keep")
    return rows.withColumn("action", action).withColumn("new_type", F.when(F.col("action") == "keep", F.col("type")).when(F.col("action") == "retype", best["t"])).select(*pred.columns, "action", "new_type")


def strata(spans: DataFrame, index: DataFrame) -> DataFrame:
    """Spans (type, surface) with ``stratum``: seen with this type, seen with other types only, unseen."""
    rows = spans.withColumn("key", normalize_mention(F.col("surface"))).join(index.select("key", "types"), "key", "left")
    unseen = F.col("types").isNull() | (F.size("types") == 0)
    return rows.withColumn("stratum", F.when(unseen, "C_unseen").when(F.map_contains_key("types", F.col("type")), "A_seen_same_type").otherwise("B_seen_other_type")).select(*spans.columns, "stratum")


def decontaminate(pool: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Pool rows (text) whose lower-case text with single spaces does not occur in the evaluation texts."""
    norm = F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " "))
    return pool.withColumn("__k", norm).join(evaluation.select(norm.alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def dedup_with_counts(df: DataFrame, text: str = "text", order: str = "pos") -> DataFrame:
    """The first row of each text (white space collapsed) with ``copies``. Aggregated, so a hot text is one row from each task."""
    norm = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", " "))
    return df.groupBy(norm.alias("__k")).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.col(order)).alias("r"), F.count("*").alias("copies")).select("r.*", "copies")


def novel_mentions(test: DataFrame, known: DataFrame, shortest: int = 5) -> DataFrame:
    """Keys of the test data only: absent from ``known``, long enough, with a letter."""
    return test.select("key").where((F.length("key") >= shortest) & F.col("key").rlike(r"\p{L}")).exceptAll(known.select("key")).distinct().join(known.select("key").distinct(), "key", "left_anti")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
