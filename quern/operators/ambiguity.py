"""Does an answer need a choice that the question leaves open?

Two detectors, evidence in the retrieved rows first, then the registry's own
structure.  docs are (query_id, rank, injected, type, id_service, id_variation,
variation_short_name, content); blocks the same without rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import anchor_terms, any_of, collapse_dotted, content_words, intents, is_targeted, normal, stem, tokens
from quern.operators import phrases
from quern.operators.context import differing_sections, universal_rows
from quern.profile import MACEDONIAN, Profile
from quern.tables import stored

SHORT = 5


def labels_of(blocks: DataFrame) -> DataFrame:
    """(id_service, id_variation, label) of all named variations."""
    named = blocks.where("id_variation IS NOT NULL AND variation_short_name IS NOT NULL AND variation_short_name <> ''")
    return named.groupBy("id_service", "id_variation").agg(F.min("variation_short_name").alias("label"))


#: Fixed value: how the corpus defines an abbreviation.
GLOSSARY = r"^Термин:\s*(.+?)\s*\(\s*([А-ШЀ-ӿA-Z][А-ШЀ-ӿA-Z0-9]{1,7})\s*\)\s*\|"


def abbreviations(blocks: DataFrame) -> DataFrame:
    """(abbreviation, term) that terminology blocks (pos, type, content) define; the first by pos wins."""
    own = blocks.where("type = 'terminology'").select("pos", F.regexp_extract("content", GLOSSARY, 2).alias("abbreviation"), F.trim(F.regexp_replace(F.regexp_extract("content", GLOSSARY, 1), r"\s+", " ")).alias("term"))
    return own.where("abbreviation <> ''").groupBy("abbreviation").agg(F.min_by("term", "pos").alias("term"))


def synonyms(label: Column, term: Column, profile: Profile = MACEDONIAN) -> Column:
    """What users type for a label: its written-out term, then the profile's words; each once by its normal form, not the label."""
    known = F.lit(None).cast("array<string>")
    for name, words in profile.form_synonyms.items():
        known = F.when(F.trim(label) == name, F.array(*map(F.lit, words))).otherwise(known)
    none = F.array().cast("array<string>")
    every = F.concat(F.when(term.isNotNull(), F.array(term)).otherwise(none), F.coalesce(known, none))
    placed = F.transform(every, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.filter(placed, lambda p: (p["k"] != F.lower(label)) & ~F.exists(F.slice(placed, F.lit(1), p["i"]), lambda q: q["k"] == p["k"])), lambda p: p["x"])


def with_synonyms(labels: DataFrame, profile: Profile = MACEDONIAN, glossary: DataFrame | None = None) -> DataFrame:
    """labels with names: the label, its comma parts and what users type for it, the glossary's terms included."""
    if glossary is not None:
        labels = labels.join(glossary.withColumnRenamed("abbreviation", "label"), "label", "left")
    parts = F.filter(F.transform(F.split("label", ","), lambda p: F.trim(p)), lambda p: F.char_length(p) > 1)
    typed = synonyms(F.col("label"), F.col("term") if glossary is not None else F.lit(None).cast("string"), profile)
    return labels.withColumn("names", F.array_distinct(F.concat(F.array("label"), parts, typed))).drop("term")


def form_label(label: Column, typed: Column) -> Column:
    """The label as a menu shows it: with up to three words that users know."""
    return F.when(F.size(typed) > 0, F.concat(label, F.lit(" ("), F.array_join(F.slice(typed, 1, 3), " / "), F.lit(")"))).otherwise(label)


def names_one(q: Column, names: Column) -> Column:
    """Whether a reply in normal form holds one of the lower-case names, short ones and comma parts as whole words."""
    whole = lambda x: F.regexp_like(q, F.concat(F.lit(r"(?U)(?<!\w)\Q"), x, F.lit(r"\E(?!\w)")))

    def hit(name: Column) -> Column:
        parts = F.filter(F.transform(F.split(name, ","), lambda p: F.trim(p)), lambda p: F.char_length(p) > 1)
        return F.when(F.char_length(name) <= SHORT, whole(name)).otherwise(F.contains(q, name) | F.exists(parts, whole))

    return F.exists(names, hit)


def matched_variation(replies: DataFrame, offered: DataFrame, key: tuple[str, ...] = ("query_id",), by: tuple[str, ...] = ()) -> DataFrame:
    """(key, id, label, synonyms): the first offered variation (id, label, synonyms, pos) that a reply names.

    Names of up to five characters and the comma parts of longer ones count as
    whole words, longer names anywhere.  `by` are columns that tie a reply to what
    it was offered; without any all were offered to all.
    """
    asked = replies.withColumn("q", normal(collapse_dotted("reply")))
    names = F.transform(F.concat(F.array("label"), "synonyms"), lambda x: F.lower(x))
    known = offered.withColumn("names", names)
    if by:
        met = asked.join(known, list(by)).where(names_one(F.col("q"), F.col("names")))
    else:
        named = known.select(F.explode("names").alias("name"))
        parts = named.where(F.char_length("name") > SHORT).select(F.explode(F.split("name", ",")).alias("name")).select(F.trim("name").alias("name")).where(F.char_length("name") > 1)
        whole = named.where(F.char_length("name") <= SHORT).unionByName(parts)
        hits = phrases.find(asked, whole, "q", "name", key, "whole").unionByName(phrases.find(asked, named.where(F.char_length("name") > SHORT), "q", "name", key, "anywhere"))
        spelled = known.select("*", F.explode(F.array_distinct(F.concat("names", F.flatten(F.transform(F.filter("names", lambda n: F.char_length(n) > SHORT), lambda n: F.transform(F.split(n, ","), lambda p: F.trim(p))))))).alias("name"))
        met = hits.select(*key, "name").distinct().join(spelled, "name")
    return met.groupBy(*key).agg(F.min_by(F.struct("id", "label", "synonyms"), "pos").alias("x")).select(*key, "x.*")


def names_form(query: Column, names: Column, label: Column, profile: Profile = MACEDONIAN) -> Column:
    """Short names as whole words, long names anywhere, or the label's first word by its stem."""
    q = F.lower(collapse_dotted(query))
    padded = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(q, F.lit("(?U)(\\w+)"), F.lit(1)), " "), F.lit(" "))

    def hit(name: Column) -> Column:
        low = F.lower(name)
        plain = F.array_join(F.regexp_extract_all(low, F.lit("(?U)(\\w+)"), F.lit(1)), " ")
        return F.when(F.char_length(low) <= SHORT, F.contains(padded, F.concat(F.lit(" "), plain, F.lit(" ")))).otherwise(F.contains(q, low))

    head = stem(F.get(content_words(label, profile, is_normal=True), F.lit(0)), profile)
    return F.exists(names, hit) | ((F.char_length(label) > SHORT) & (F.char_length(head) >= 4) & F.array_contains(tokens(q, profile, is_normal=True), head))


def legal_forms(blocks: DataFrame, profile: Profile = MACEDONIAN) -> DataFrame:
    """(label): variations' labels that several services use, or that have synonyms."""
    used = labels_of(blocks).groupBy("label").agg(F.count_distinct("id_service").alias("n"))
    return used.where((F.col("n") >= 2) | F.col("label").isin(list(profile.form_synonyms))).select("label")


def known_form_names(blocks: DataFrame, profile: Profile = MACEDONIAN) -> DataFrame:
    """Legal forms and the abbreviations in capitals inside them."""
    forms = legal_forms(blocks, profile)
    short = forms.select(F.explode(F.regexp_extract_all("label", F.lit("(?<!\\p{L})(\\p{Lu}{2,6})(?!\\p{L})"), F.lit(1))).alias("label"))
    return forms.unionByName(short).distinct()


def named_labels(queries: DataFrame, forms: DataFrame, profile: Profile = MACEDONIAN) -> DataFrame:
    """(query_id, label) of forms (label, names) that queries name, by the rules of names_form, each rule a lookup of its own."""
    low = F.lower(collapse_dotted("query"))
    asked = queries.select("query_id", low.alias("q")).withColumn("padded", F.concat(F.lit(" "), F.array_join(F.regexp_extract_all("q", F.lit("(?U)(\\w+)"), F.lit(1)), " "), F.lit(" ")))
    names = forms.select("label", F.explode("names").alias("name")).withColumn("name", F.lower("name"))
    plain = F.array_join(F.regexp_extract_all("name", F.lit("(?U)(\\w+)"), F.lit(1)), " ")
    short = stored(names.where(F.char_length("name") <= SHORT).select("label", F.concat(F.lit(" "), plain, F.lit(" ")).alias("name")).distinct(), "short")
    long = stored(names.where(F.char_length("name") > SHORT).distinct(), "long")
    met = phrases.find(asked, short, "padded", "name", ("query_id",), "anywhere").join(short, "name").select("query_id", "label")
    met = met.unionByName(phrases.find(asked, long, "q", "name", ("query_id",), "anywhere").join(long, "name").select("query_id", "label"))
    heads = forms.where(F.char_length("label") > SHORT).select("label", stem(F.get(content_words("label", profile, is_normal=True), F.lit(0)), profile).alias("term")).where(F.char_length("term") >= 4)
    terms = asked.select("query_id", F.explode(F.array_distinct(tokens("q", profile, is_normal=True))).alias("term"))
    return met.unionByName(terms.join(heads, "term").select("query_id", "label")).distinct()


def named_forms(queries: DataFrame, blocks: DataFrame, profile: Profile = MACEDONIAN) -> DataFrame:
    """(query_id, forms): labels of legal forms that a query names, sorted."""
    met = named_labels(queries, with_synonyms(legal_forms(blocks, profile), profile), profile)
    return met.groupBy("query_id").agg(F.sort_array(F.collect_set("label")).alias("forms"))


def _naming(queries: DataFrame, services: DataFrame, blocks: DataFrame, profile: Profile) -> DataFrame:
    """Of (query_id, id_service): whether the query names one of its forms, or a form that it lacks."""
    own = services.join(with_synonyms(labels_of(blocks), profile), "id_service").join(queries.select("query_id", "query"), "query_id")
    said = own.groupBy("query_id", "id_service").agg(F.max(names_form(F.col("query"), F.col("names"), F.col("label"), profile)).alias("own"))
    absent = named_labels(queries, with_synonyms(known_form_names(blocks, profile), profile), profile).select("query_id").distinct().withColumn("known", F.lit(True))
    return said.join(absent, "query_id", "left").where("own OR known").select("query_id", "id_service")


def anchored_docs(queries: DataFrame, docs: DataFrame, blocks: DataFrame, profile: Profile = MACEDONIAN) -> DataFrame:
    """(query_id, id_service) of rows whose content or service's name shares a stem with the query's own anchor terms."""
    asked = queries.select("query_id", F.explode(anchor_terms("query", profile)).alias("term"))
    names = blocks.where("id_service IS NOT NULL").groupBy("id_service").agg(F.min("service_name").alias("named")) if "service_name" in blocks.columns else blocks.select("id_service", F.lit("").alias("named")).distinct()
    own = docs.where("id_service IS NOT NULL").select("query_id", "id_service", "content").join(names, "id_service", "left")
    held = own.select("query_id", "id_service", F.explode(F.array_distinct(tokens(F.concat_ws(" ", "named", "content"), profile))).alias("term"))
    return held.join(asked, ["query_id", "term"], "left_semi").select("query_id", "id_service").distinct()


def anchored_votes(docs: DataFrame, anchored: DataFrame) -> DataFrame:
    """(query_id, id_service) of each query's best row; where the query anchors services, only rows of these count."""
    held = docs.join(anchored.withColumn("held", F.lit(True)), ["query_id", "id_service"], "left").join(anchored.select("query_id").distinct().withColumn("any", F.lit(True)), "query_id", "left")
    return held.where("any IS NULL OR held").groupBy("query_id").agg(F.min_by("id_service", F.struct("rank", "id_service")).alias("id_service"))


def detect(queries: DataFrame, docs: DataFrame, blocks: DataFrame, profile: Profile = MACEDONIAN) -> DataFrame:
    """(query_id, id_service, section_types, variations, source) where the user must be asked.

    Naming a form of the service, or one that it lacks, settles the question.
    All labelled forms are offered, sorted by label.
    """
    asked = queries.withColumn("intents", intents("query", profile))
    differs = stored(differing_sections(blocks, "id_service", "id_variation", "type", "content").select("id_service", "type"), "differs")
    universal = stored(universal_rows(blocks, "id_service", "id_variation", "type", "content").select("id_service", "type", "content", F.lit(True).alias("universal")), "universal")
    own = docs.where("NOT injected AND id_variation IS NOT NULL AND variation_short_name IS NOT NULL").join(universal, ["id_service", "type", "content"], "left")
    clash = own.where("universal IS NULL").groupBy("query_id", "id_service", "type").agg(F.count_distinct("id_variation").alias("n")).where("n >= 2")
    first = docs.groupBy("query_id", "id_service").agg(F.min("rank").alias("rank"))
    clash = clash.join(asked.select("query_id", "intents"), "query_id").where(F.array_contains("intents", F.col("type"))).join(differs, ["id_service", "type"], "left_semi")
    clash = stored(clash, "clash")
    evidence = clash.join(first, ["query_id", "id_service"]).groupBy("query_id").agg(F.min(F.struct("rank", "id_service"))["id_service"].alias("id_service"))
    evidence = evidence.join(clash, ["query_id", "id_service"]).groupBy("query_id", "id_service").agg(F.sort_array(F.collect_set("type")).alias("section_types")).withColumn("source", F.lit("evidence"))
    evidence = stored(evidence, "evidence")

    votes = anchored_votes(docs.where("id_variation IS NOT NULL"), stored(anchored_docs(queries, docs, blocks, profile), "anchored"))
    top = votes.join(asked.select("query_id", "query", F.get("intents", F.lit(0)).alias("type")), "query_id").where("type IS NOT NULL").join(differs, ["id_service", "type"], "left_semi")
    seen = docs.where("NOT injected").join(universal, ["id_service", "type", "content"], "left").groupBy("query_id", "id_service", "type").agg(F.count("*").alias("n"), F.count("universal").alias("n_universal"))
    top = top.join(seen, ["query_id", "id_service", "type"], "left").na.fill(0, ["n", "n_universal"])
    exempt = (F.col("n") > 0) & ((F.col("n") == F.col("n_universal")) | ((F.col("n_universal") > 0) & is_targeted("query", profile)))
    structure = top.where(~exempt).select("query_id", "id_service", F.array("type").alias("section_types"), F.lit("structure").alias("source")).join(evidence, "query_id", "left_anti")

    both = stored(evidence.unionByName(structure), "open")
    both = both.join(_naming(queries, both.select("query_id", "id_service"), blocks, profile), ["query_id", "id_service"], "left_anti")
    offered = labels_of(blocks).groupBy("id_service").agg(F.array_sort(F.collect_list(F.struct("label", "id_variation"))).alias("variations"))
    return both.join(offered, "id_service").where(F.size("variations") >= 2).select("query_id", "id_service", "section_types", "variations", "source")


# Words of labels that are ways of access, and the two questions.
CHANNEL_WORDS = ("хартиено", "електронски", "шалтер", "web", "сервис", "пошта")
CHANNEL_LEAD, FORM_LEAD = "На кој начин сакате да ја користите услугата?", "За каква правна форма станува збор?"


def clarification(found: DataFrame, profile: Profile = MACEDONIAN) -> DataFrame:
    """The question to the user, of access or of form, and one line an option."""
    labels = F.transform("variations", lambda v: form_label(v["label"], synonyms(v["label"], F.lit(None).cast("string"), profile)))
    channel = F.forall(labels, lambda x: any_of(F.lower(x), CHANNEL_WORDS))
    lines = F.array_join(F.transform(labels, lambda x: F.concat(F.lit("- "), x)), "\n")
    return found.withColumn("text", F.concat(F.when(channel, CHANNEL_LEAD).otherwise(FORM_LEAD), F.lit("\n\n"), lines))
