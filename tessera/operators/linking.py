"""Links between artifacts of different domains: phrases, references, candidates and verdicts.

Linkable artifacts have artifact_id, artifact_type, title, body_text, source_type, external_id, path
and branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.written import written
from .matching import small, strings_in_texts

# Which types count as code, document, card and commit.
CODE_TYPES = ("code_file", "code_symbol", "endpoint")
DOC_TYPES = ("chunk", "summary", "source_backed_fact")
DOC_SOURCES = ("azure_wiki", "github_doc")
CARD_SOURCES = ("ado_card",)
COMMIT_SOURCES = ("git_metadata",)
# Confidences of deterministic links, floors and scores of candidate signals.
IMPLEMENTS, DOC_LINK, MENTIONS = 0.95, 0.9, 0.95
EMBEDDING_FLOOR, TOKEN_FLOOR, SECTION_SCORE, PATH_SCORE = 0.80, 0.10, 0.6, 0.4
FAN_OUT = 10
WORD = "[\\p{L}\\p{N}_]"


def _keys(c: Column) -> Column:
    """Hashes of a text's neighbouring runs of word characters in lower case, and of the runs themselves: (pairs, single)."""
    runs = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}_]+"), lambda r: r != "")
    pairs = F.zip_with(runs, F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y)))
    return F.struct(F.array_distinct(F.array_compact(pairs)).alias("pairs"), F.array_distinct(F.transform(runs, lambda r: F.xxhash64(r))).alias("single"))


def titles_in_texts(titles: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (title_id, text_id): the title stands in the text, between the borders that its rule asks for.

    ``titles``: title_id, title, rule ('phrase': any case, word borders; 'symbol': no word character
    or dot before it, no word character behind; 'path': no word character or slash on either side);
    ``texts``: text_id, text.  Ids are unique on both sides.  A title's runs of word characters stand whole and side by side in
    a text that holds it, so the two neighbouring runs that fewest texts have, or its only run, find the candidates by an equi
    join on hashes.  Equal titles are looked for once, and a text meets all its candidates at once.  A title without any such
    run is left out.
    """
    return _found_titles(titles, texts).select("title_id", "text_id")


def _found_titles(titles: DataFrame, texts: DataFrame) -> DataFrame:
    """``titles_in_texts`` with the rule."""
    titles = written(titles.where("title is not null").select("title_id", "title", "rule"), "titles")
    k = titles.select("title", "rule").distinct().withColumn("k", _keys(F.col("title")))
    t = written(k.select("title", "rule", F.explode(F.when(F.size("k.pairs") > 0, F.col("k.pairs")).otherwise(F.col("k.single"))).alias("key")), "keys")
    wanted = written(t.select("key").distinct(), "wanted")
    have = texts.select("text_id", _keys(F.col("text")).alias("k")).select("text_id", F.explode(F.concat("k.pairs", "k.single")).alias("key"))
    have = written(have.join(small(wanted), "key", "left_semi"), "having")
    df = have.groupBy("key").agg(F.count("*").alias("df"))
    # All of a title's keys must be known.
    rare = t.join(df, "key", "left").groupBy("title", "rule").agg(F.min(F.coalesce("df", F.lit(0))).alias("least"), F.min_by("key", F.struct("df", "key")).alias("key")).where("least > 0")
    met = have.join(rare.select("title", "rule", "key"), "key").groupBy("text_id").agg(F.collect_list(F.struct("title", "rule")).alias("met"))
    pairs = texts.join(met, "text_id").select("text_id", "text", F.concat(F.lit(" "), F.lower("text"), F.lit(" ")).alias("low"), "met").select("text_id", "text", "low", F.explode("met").alias("m")).select("text_id", "text", "low", "m.title", "m.rule")
    any_case = F.col("rule") == "phrase"
    near = F.contains(F.when(any_case, F.col("low")).otherwise(F.col("text")), F.when(any_case, F.lower("title")).otherwise(F.col("title")))
    starts, ends = F.col("title").rlike(f"^{WORD}"), F.col("title").rlike(f"{WORD}$")
    before = F.when(F.col("rule") == "symbol", f"(?<!{WORD[:-1]}.])").when(F.col("rule") == "path", f"(?<!{WORD[:-1]}/])").otherwise(F.when(starts, f"(?<!{WORD})").otherwise(f"(?<={WORD})"))
    behind = F.when(F.col("rule") == "symbol", f"(?!{WORD})").when(F.col("rule") == "path", f"(?!{WORD[:-1]}/])").otherwise(F.when(ends, f"(?!{WORD})").otherwise(f"(?={WORD})"))
    pattern = F.concat(F.when(any_case, F.lit("(?iu)")).otherwise(F.lit("")), before, F.lit("\\Q"), F.replace("title", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"), behind)
    # Between spaces, a phrase of letters whose cases are one character each stands surely; a pattern is compiled and searched for the rest only.
    sure = any_case & F.col("title").rlike(f"^(?=[\\x00-\\x7F\\xE0-\\xF6]+$){WORD}(.*{WORD})?$") & F.contains("low", F.concat(F.lit(" "), F.lower("title"), F.lit(" ")))
    hits = pairs.where(near).where(sure | F.rlike("text", pattern)).select("text_id", "title", "rule")
    return hits.join(titles, ["title", "rule"]).select("title_id", "text_id", "rule")


def phrase_links(artifacts: DataFrame) -> DataFrame:
    """Edges where one artifact's title stands in another's text; no artifact links to itself."""
    a = artifacts.where("title is not null")
    concepts = a.where((F.col("artifact_type") == "concept") & ((F.instr(F.trim("title"), " ") > 0) | (F.length("title") >= 6)))
    symbols = a.where((F.col("artifact_type") == "code_symbol") & (F.length("title") >= 4))
    files = a.where(F.col("artifact_type").isin(*CODE_TYPES) & (F.col("artifact_type") != "code_symbol"))
    titled = lambda d, rule: d.select(F.col("artifact_id").alias("title_id"), "title", F.lit(rule).alias("rule"))
    told = concepts.select(F.col("artifact_id").alias("text_id"), F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("body_text", F.lit(""))).alias("text"))
    docs = artifacts.where(F.col("artifact_type").isin(*DOC_TYPES) & F.col("source_type").isin(*DOC_SOURCES, *CARD_SOURCES) & F.col("body_text").isNotNull())
    bodies = docs.select(F.col("artifact_id").alias("text_id"), F.col("body_text").alias("text"))
    card = docs.select(F.col("artifact_id").alias("text_id"), F.when(F.col("source_type").isin(*CARD_SOURCES), "requests").otherwise("documents").alias("edge_type"))
    implements = titles_in_texts(titled(symbols, "symbol"), told).select(F.col("title_id").alias("from_artifact_id"), F.col("text_id").alias("to_artifact_id"), F.lit("implements").alias("edge_type"), F.lit(IMPLEMENTS).alias("confidence"))
    # Kinds of titles meet the bodies in one search.
    named = _found_titles(titled(concepts, "phrase").unionAll(titled(symbols, "symbol")).unionAll(titled(files, "path")), bodies).join(card, "text_id")
    told_by = F.when(F.col("rule") == "phrase", F.col("edge_type")).otherwise("mentions")
    named = named.select(F.col("text_id").alias("from_artifact_id"), F.col("title_id").alias("to_artifact_id"), told_by.alias("edge_type"), F.lit(DOC_LINK).alias("confidence"))
    return implements.unionAll(named).where("from_artifact_id <> to_artifact_id")


def work_item_index(artifacts: DataFrame) -> DataFrame:
    """(key, item_id): external id, its digit runs and those of the title; the smallest artifact has a key."""
    cards = artifacts.where(F.col("source_type").isin(*CARD_SOURCES))
    digits = lambda c: F.coalesce(F.regexp_extract_all(F.col(c), F.lit("[0-9]+"), F.lit(0)), F.array().cast("array<string>"))
    keys = F.array_compact(F.concat(F.array(F.trim("external_id")), digits("external_id"), digits("title")))
    return cards.select("artifact_id", F.explode(F.array_distinct(keys)).alias("key")).where("key <> ''").groupBy("key").agg(F.min("artifact_id").alias("item_id"))


def _ref_links(sources: DataFrame, artifacts: DataFrame, edge_type: str) -> DataFrame:
    """``sources``: artifact_id, refs (structs of key and matched); the first reference to an item is its evidence."""
    refs = sources.select("artifact_id", F.posexplode("refs").alias("pos", "ref")).select("artifact_id", "pos", "ref.key", "ref.matched")
    j = refs.join(work_item_index(artifacts), "key").where("artifact_id <> item_id")
    g = j.groupBy("artifact_id", "item_id").agg(F.min_by("matched", "pos").alias("matched"))
    return g.select(F.col("artifact_id").alias("from_artifact_id"), F.col("item_id").alias("to_artifact_id"), F.lit(edge_type).alias("edge_type"), F.lit(IMPLEMENTS).alias("confidence"), "matched")


def commit_work_item_links(artifacts: DataFrame) -> DataFrame:
    """Commits implement the work items that message or branch name."""
    commits = artifacts.where("artifact_type = 'commit'")
    return _ref_links(commits.select("artifact_id", text.work_item_matches(F.coalesce("body_text", F.lit("")), F.col("branch")).alias("refs")), artifacts, "implements")


def doc_work_item_links(artifacts: DataFrame) -> DataFrame:
    """Documents mention the work items that they name; branches don't count."""
    docs = artifacts.where(F.col("artifact_type").isin(*DOC_TYPES) & F.col("source_type").isin(*DOC_SOURCES, *CARD_SOURCES) & F.col("body_text").isNotNull())
    return _ref_links(docs.select("artifact_id", text.work_item_matches(F.col("body_text")).alias("refs")), artifacts, "mentions")


def commit_commit_links(artifacts: DataFrame) -> DataFrame:
    """Commits implement commits that they name: by whole id, else by a prefix that one commit alone has.

    A reference has 7 digits at least, so prefixes meet ids on their first 7.
    """
    commits = artifacts.where("artifact_type = 'commit'")
    ids = commits.where("external_id <> ''").groupBy("external_id").agg(F.max("artifact_id").alias("target"))
    refs = commits.select("artifact_id", F.explode(text.sha_refs(F.coalesce("body_text", F.lit("")))).alias("ref"))
    j = refs.join(ids.withColumn("head", F.substring("external_id", 1, 7)), F.substring("ref", 1, 7) == F.col("head")).where(F.startswith("external_id", F.col("ref")))
    g = j.groupBy("artifact_id", "ref").agg(F.max(F.when(F.col("external_id") == F.col("ref"), F.col("target"))).alias("exact"), F.count("*").alias("n"), F.min("target").alias("only"))
    found = g.select("artifact_id", "ref", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("target")).where("target <> artifact_id")
    g = found.groupBy("artifact_id", "target").agg(F.min("ref").alias("matched"))
    return g.select(F.col("artifact_id").alias("from_artifact_id"), F.col("target").alias("to_artifact_id"), F.lit("implements").alias("edge_type"), F.lit(IMPLEMENTS).alias("confidence"), "matched")


def commit_file_links(artifacts: DataFrame) -> DataFrame:
    """Commits mention the code files at the paths that they change."""
    files = artifacts.where("artifact_type = 'code_file' and path is not null").groupBy("path").agg(F.max("artifact_id").alias("file_id"))
    changed = artifacts.where("artifact_type = 'commit'").select("artifact_id", F.explode(text.parse_changed_files(F.coalesce("body_text", F.lit("")))).alias("path"))
    j = changed.join(files, "path").where("artifact_id <> file_id")
    return j.groupBy(F.col("artifact_id").alias("from_artifact_id"), F.col("file_id").alias("to_artifact_id")).agg(F.min("path").alias("matched")).select("from_artifact_id", "to_artifact_id", F.lit("mentions").alias("edge_type"), F.lit(MENTIONS).alias("confidence"), "matched")


DOMAINS = ("commit", "card", "doc", "code", "other")
#: Artifacts that share a token before it is hot; links of an artifact before it is a hub.
HOT_TOKEN, HUB_LINKS = 100, 50


def domain(source_type: Column, artifact_type: Column, path: Column) -> Column:
    return (
        F.when(source_type.isin(*COMMIT_SOURCES), "commit").when(source_type.isin(*CARD_SOURCES), "card").when(source_type.isin(*DOC_SOURCES), "doc")
        .when(artifact_type.isin(*CODE_TYPES) | path.isNotNull(), "code").otherwise("other")
    )


def _first_ids(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` smallest ids of each group; tasks keep no more than that before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("artifact_id"))).where(F.col("_r") <= k).drop("_r")


def _within(rows: DataFrame, taken: DataFrame, k: int) -> DataFrame:
    """Rows (a, b) whose place ``_r`` is among the ``k`` first of a, or as many more as a has links (``taken``: artifact_id, links)."""
    more = rows.join(small(taken.select(F.col("artifact_id").alias("a"), "links")), "a", "left")
    return more.where(F.col("_r") <= k + F.coalesce("links", F.lit(0))).select("a", "b")


def _overlap_partners(sets: DataFrame, hubs: DataFrame, k: int, hot: int, taken: DataFrame | None = None, links: int = 0) -> DataFrame:
    """Pairs (a, b) of different domains that hold each artifact's ``k`` best by token overlap, ties to smaller ids.

    With ``taken`` (artifact_id, links: at most ``links``, or a hub) there are as many more for each artifact as it has links.

    Tokens of at most ``hot`` artifacts are joined.  Hot ones are met by class: artifacts of one domain with the same hot tokens
    and the same number of tokens overlap alike with another class, as far as hot tokens go, so of each class only the ``k``
    smallest ids can be among anybody's best, and of all classes the ``k`` best in order of overlap and id.  What shares
    a cold token besides is better than its class and is found by that token.  ``hubs`` meet all artifacts that share a token.
    """
    flat = written(sets.where("n > 0").select("artifact_id", "domain", "n", F.explode("tokens").alias("token")), "tokens")
    df = written(flat.groupBy("token").agg(F.count("*").alias("df")), "frequencies")
    cold = flat.join(df.where(F.col("df") <= hot), "token").select("artifact_id", "domain", "token")
    pair = lambda x, y: x.select(F.col("artifact_id").alias("a"), F.col("domain").alias("da"), "token").join(y.select(F.col("artifact_id").alias("b"), F.col("domain").alias("db"), "token"), "token").where("da <> db").select("a", "b").distinct()
    met = pair(cold, cold)
    of_hubs = flat.join(hubs, "artifact_id", "left_semi")
    met = met.unionAll(pair(of_hubs, flat))
    warm = flat.join(df.where(F.col("df") > hot), "token").groupBy("artifact_id", "domain", "n").agg(F.array_sort(F.collect_list("token")).alias("hot"))
    members = written(warm.withColumn("kind", F.concat_ws(" ", "domain", F.col("n").cast("string"), F.concat_ws(" ", "hot"))), "classes")
    kinds = members.select("kind", "domain", "n", "hot").distinct()
    side = lambda x: kinds.select(F.col("kind").alias(f"kind_{x}"), F.col("domain").alias(f"d{x}"), F.col("n").alias(f"n{x}"), F.explode("hot").alias("token"))
    alike = side("a").join(side("b"), "token").where("da <> db").groupBy("kind_a", "kind_b", "na", "nb").agg(F.count("*").alias("c"))
    alike = alike.withColumn("score", F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).where(F.col("score") >= TOKEN_FLOOR)
    first = _first_ids(members.select(F.col("kind").alias("kind_b"), "artifact_id"), ["kind_b"], k + links)
    offered = alike.join(first, "kind_b").withColumn("_r", F.row_number().over(Window.partitionBy("kind_a").orderBy(F.desc("score"), "artifact_id"))).where(F.col("_r") <= k + links)
    offered = members.select("kind", F.col("artifact_id").alias("a")).join(offered.select(F.col("kind_a").alias("kind"), F.col("artifact_id").alias("b"), "_r"), "kind")
    return met.unionAll(offered.select("a", "b") if taken is None else _within(offered, taken, k))


def _folder_partners(sets: DataFrame, hubs: DataFrame, k: int, taken: DataFrame | None = None, links: int = 0) -> DataFrame:
    """Pairs (a, b): each artifact with the ``k`` smallest ids of its folder in other domains, and as many more as it has links; hubs with all of them."""
    f = sets.where("folder IS NOT NULL").select("artifact_id", "domain", "folder")
    other = F.explode(F.filter(F.array(*map(F.lit, DOMAINS)), lambda d: d != F.col("domain"))).alias("domain")
    # A folder's rows for a domain are those of all others, so a place counts all that the domain may take.
    first = f.select("artifact_id", "folder", other).withColumn("_r", F.row_number().over(Window.partitionBy("folder", "domain").orderBy("artifact_id"))).where(F.col("_r") <= k + links)
    near = f.withColumnRenamed("artifact_id", "a").join(first.withColumnRenamed("artifact_id", "b"), ["folder", "domain"])
    near = near.select("a", "b") if taken is None else _within(near, taken, k)
    of_hubs = f.join(hubs, "artifact_id", "left_semi").toDF("a", "da", "folder").join(f.toDF("b", "db", "folder"), "folder").where("da <> db").select("a", "b")
    return near.unionAll(of_hubs)


def _named_partners(named: DataFrame, needles: DataFrame, hubs: DataFrame, k: int, taken: DataFrame | None = None, links: int = 0) -> DataFrame:
    """Pairs (a, b): each artifact with the ``k`` smallest ids of other domains that its text names, and as many more as it has links; hubs with all of them.

    Named pairs score alike but for what other generators find, so larger ids can't be among anybody's best.  ``named``: a, needle;
    ``needles``: artifact_id, domain, needle.
    """
    n = named.join(needles.select(F.col("artifact_id").alias("a"), F.col("domain").alias("da")), "a")
    first = small(written(_first_ids(needles, ["needle", "domain"], k + links).toDF("b", "db", "needle"), "first"))
    near = n.join(first, "needle").where("da <> db").withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("_r") <= k + links)
    near = near.select("a", "b") if taken is None else _within(near, taken, k)
    of_hubs = n.join(hubs.toDF("a"), "a", "left_semi").join(needles.toDF("b", "db", "needle"), "needle").where("da <> db").select("a", "b")
    return near.unionAll(of_hubs)


def candidate_pairs(artifacts: DataFrame, existing: DataFrame, similar: DataFrame | None = None, fan_out: int = FAN_OUT, hot: int = HOT_TOKEN, links: int = HUB_LINKS) -> DataFrame:
    """Ordered pairs of different domains that some signal joins: (from, to, signals, score, bucket).

    ``existing`` (a, b) are linked pairs, in either order, which are left out; ``similar`` (a, b,
    similarity) are given neighbours.  Signals: similarity, overlap of tokens, one's text naming the
    other's path or title, one folder.  A pair has the value of each of its signals, an artifact its ``fan_out``
    best pairs: that bound is the operator's result.

    Generators offer, for each signal, all pairs that may be among an artifact's best, never all pairs of a token or a
    folder: an artifact's own links take as many places away, and artifacts with more than ``links`` (hubs) meet all they may.
    """
    a = artifacts.select("artifact_id", "title", "body_text", "path", "external_id", domain(F.col("source_type"), F.col("artifact_type"), F.col("path")).alias("domain"))
    a = written(a, "linkable")
    parts = F.split(F.lower(F.concat_ws(" ", "title", "path", "external_id")), "[^a-z0-9]+")
    folder = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    sets = a.select("artifact_id", "domain", F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 3)).alias("tokens"), folder.alias("folder")).withColumn("n", F.size("tokens"))
    sets = written(sets, "sets")
    known = written(existing.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct(), "linked")
    taken = written(known.select(F.explode(F.array("p", "q")).alias("artifact_id")).groupBy("artifact_id").agg(F.count("*").alias("links")), "taken")
    hubs = written(taken.where(F.col("links") > links).select("artifact_id"), "hubs")
    needle = F.lower(F.coalesce(F.nullif("path", F.lit("")), F.nullif("title", F.lit("")), F.lit("")))
    needles = written(a.select("artifact_id", "domain", F.when(F.length(needle) >= 4, needle).otherwise("").alias("needle")), "needles")
    told = a.select(F.col("artifact_id").alias("text_id"), F.lower("body_text").alias("text")).where("text <> ''")
    named = written(strings_in_texts(needles.select("needle"), told).toDF("a", "needle"), "named")
    offered = _overlap_partners(sets, hubs, fan_out, hot, taken, links).unionAll(_folder_partners(sets, hubs, fan_out, taken, links)).unionAll(_named_partners(named, needles, hubs, fan_out, taken, links))
    none = F.lit(None).cast("double")
    if similar is not None:
        near = similar.where(F.col("similarity") >= EMBEDDING_FLOOR).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
        offered = offered.unionAll(near.select("a", "b"))
    side = lambda x: sets.select(F.col("artifact_id").alias(x), F.col("domain").alias(f"d{x}"), F.col("tokens").alias(f"t{x}"), F.col("folder").alias(f"f{x}"))
    p = offered.where("a <> b").distinct().withColumns({"p": F.least("a", "b"), "q": F.greatest("a", "b")}).join(known, ["p", "q"], "left_anti").select("a", "b")
    p = p.join(side("a"), "a").join(side("b"), "b").where("da <> db").join(needles.select(F.col("artifact_id").alias("b"), "needle"), "b").join(named.withColumn("named", F.lit(True)), ["a", "needle"], "left")
    p = p.join(near, ["a", "b"], "left") if similar is not None else p.withColumn("similarity", none)
    overlap = F.try_divide(F.size(F.array_intersect("ta", "tb")), F.size(F.array_union("ta", "tb")))
    # In order of their names.
    told = (
        ("embedding_similarity", F.col("similarity")), ("path_colocation", F.when(F.col("fa") == F.col("fb"), PATH_SCORE)),
        ("section_proximity", F.when(F.col("named"), SECTION_SCORE)), ("token_overlap", F.when(overlap >= TOKEN_FLOOR, overlap)),
    )
    signals = F.filter(F.array(*(F.struct(F.lit(n).alias("signal"), c.cast("double").alias("score")) for n, c in told)), lambda x: x["score"].isNotNull())
    pairs = p.select("a", "b", F.map_from_entries(signals).alias("signals"), F.array_max(F.transform(signals, lambda x: x["score"])).alias("score")).where("score IS NOT NULL")
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    kept = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= fan_out)
    bucket = F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.4, "medium").otherwise("low")
    return kept.select(F.col("a").alias("from_artifact_id"), F.col("b").alias("to_artifact_id"), "signals", "score", bucket.alias("bucket"))


def semantic_links(concepts: DataFrame, linked: DataFrame, similar: DataFrame, accept: float = 0.82, top: int = 3) -> DataFrame:
    """Symbols implement the concepts without a deterministic link that they resemble.

    ``concepts``: artifact_id; ``linked``: from_artifact_id, to_artifact_id; ``similar``: concept_id,
    symbol_id, similarity.
    """
    free = concepts.select(F.col("artifact_id").alias("concept_id")).join(linked.select(F.col("to_artifact_id").alias("concept_id")), "concept_id", "left_anti")
    w = Window.partitionBy("concept_id").orderBy(F.desc("similarity"), "symbol_id")
    best = similar.join(free, "concept_id", "left_semi").withColumn("r", F.row_number().over(w)).where((F.col("r") <= top) & (F.col("similarity") >= accept))
    return best.select(F.col("symbol_id").alias("from_artifact_id"), F.col("concept_id").alias("to_artifact_id"), F.lit("implements").alias("edge_type"), F.col("similarity").alias("confidence"))


def merge_candidates(before: DataFrame, drafts: DataFrame) -> DataFrame:
    """The candidate table after a run: drafts replace rows of their pair; what isn't drafted any more is dropped."""
    keys = ["from_artifact_id", "to_artifact_id"]
    j = drafts.select(*keys, F.col("score").alias("new")).join(before.select(*keys, F.col("score").alias("old")), keys, "full")
    action = F.when(F.col("new").isNull(), "drop").when(F.col("old").isNull(), "insert").otherwise("update")
    return j.select(*keys, F.col("new").alias("score"), action.alias("action"))


def judge_edges(candidates: DataFrame, verdicts: DataFrame, live: DataFrame) -> DataFrame:
    """Edges that verdicts leave: (from, to, relation_type, trust_class, action).

    ``candidates``: from, to, spans (texts that may be quoted); ``verdicts``: from, to, relation_type,
    trust_bucket, quote; ``live``: from, to, relation_type of judged edges.  A quote that stands in no
    span makes an inferred verdict AMBIGUOUS; REJECTED gives no edge.  Live edges that no verdict
    gives any more are invalidated, unless there are no candidates at all.
    """
    keys = ["from_artifact_id", "to_artifact_id"]
    quote = text.collapsed(F.col("quote"))
    grounded = F.coalesce((quote != "") & F.exists("spans", lambda s: F.contains(text.collapsed(s), quote)), F.lit(False))
    inferred = F.col("trust_bucket").isin("INFERRED_HIGH", "INFERRED_LOW")
    j = candidates.select(*keys, "spans").join(verdicts, keys)
    j = j.select(*keys, "relation_type", F.when(inferred & ~grounded, "AMBIGUOUS").otherwise(F.col("trust_bucket")).alias("trust_class")).where("trust_class <> 'REJECTED'")
    full = j.join(live.select(*keys, "relation_type", F.lit(True).alias("live")), [*keys, "relation_type"], "full")
    action = F.when(F.col("trust_class").isNull(), "invalidate").when(F.col("live"), "refresh").otherwise("insert")
    some = candidates.agg((F.count("*") > 0).alias("some"))
    out = full.select(*keys, "relation_type", "trust_class", action.alias("action")).crossJoin(F.broadcast(some))
    return out.where("some or action <> 'invalidate'").drop("some")
