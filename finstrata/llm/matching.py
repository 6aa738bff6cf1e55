"""Companies of two sources without a common key.

Method: a deterministic cascade of rules, in passes: records are joined exactly on their name's own letters, then
on those with one, then with two letters left out, together with the digits of a registration number or with what both
state of line of business, country, town and legal form. In a pass the rule that asks for most is the
first; records a pass resolves are anti-joined away before the next, which also asks for equal names again.
A pair's confidence is its rule's precision with add-one smoothing, measured on the pairs the rule would choose if it didn't see
the digits: where both sides show digits of a registration number, their agreement labels such a pair.

No group is joined pair by pair: records alike in all attributes are a class of which two stand for all, as a third
adds nothing to the knowledge that a partner isn't the only one; their digits still tell them apart.
No join broadcasts a side (`merge` hints): each grows with the records, and the driver would hold what Spark takes for small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.functions.text import fold
from finstrata.session import cut_lineage

# Lines of business in a company's name, in Croatian and English.
LINES = {
    "shipbuilding": ("brodogradnja", "shipbuilding"), "electronics": ("elektronika", "electronics"), "energy": ("energetika", "energy"),
    "construction": ("građenje", "construction"), "hotels": ("hoteli", "hotels"), "engineering": ("inženjering", "engineering"),
    "metallurgy": ("metalurgija", "metallurgy"), "real estate": ("nekretnine", "real estate"), "insurance": ("osiguranje", "insurance"),
    "paper": ("papir", "paper"), "food": ("prehrana", "foods", "food"), "transport": ("promet", "transport"), "fisheries": ("ribarstvo", "fisheries"),
    "textiles": ("tekstil", "textile", "textiles"), "trade": ("trgovina", "trade"), "tourism": ("turizam", "tourism"),
}
# Legal forms after folding, with blanks for all that isn't a letter or digit.
FORMS = {
    "limited": r"drustvo s ogranicenom odgovornoscu|j ?d ?o ?o|d ?o ?o|llc|ltd|limited|gmbh",
    "stock": r"dionicko drustvo|joint stock company|d ?d|plc|a ?d|ag",
}
# What may follow a name without being part of it.
FILLERS = r"za usluge|za proizvodnju i trgovinu|za proizvodnju|za trgovinu|holding|group|grupa|hr|ba|si|rs|at"
TOWN_FILLERS = r"^(?:grad|opcina|mjesto) "


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def _fold(text: str) -> str:
    """`fold` for the fixed lists."""
    import unicodedata

    return "".join(x for x in unicodedata.normalize("NFD", text.replace("đ", "d")) if not unicodedata.combining(x)).lower()


def _without(c: Column, words: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"\b(?:{words})\b", " "), " +", " "))


def legal_form(name: Column) -> Column:
    """The class of legal form the name ends with, else null."""
    plain = _plain(name)
    out = None
    for form, words in FORMS.items():
        hit = plain.rlike(rf"(?:^| )(?:{words})$")
        out = F.when(hit, form) if out is None else out.when(hit, form)
    return out


def business_line(name: Column) -> Column:
    plain = _plain(name)
    out = None
    for line, words in LINES.items():
        hit = plain.rlike(rf"\b(?:{'|'.join(map(_fold, words))})\b")
        out = F.when(hit, line) if out is None else out.when(hit, line)
    return out


def name_core(name: Column) -> Column:
    """The name's own letters: without legal form, line of business, fillers and what follows a comma; null if nothing is left."""
    forms = "|".join(FORMS.values())
    lines = "|".join(_fold(w) for words in LINES.values() for w in words)
    head = F.regexp_extract(name, r"^[\s\"“”„',]*([^,]+)", 1)
    core = F.regexp_replace(_plain(head), rf" (?:{forms})$", "")
    core = F.regexp_replace(_without(_without(core, FILLERS), lines), " ", "")
    return F.when(core != "", core)


def town_key(town: Column) -> Column:
    t = F.regexp_replace(_plain(town), TOWN_FILLERS, "")
    return F.when(t != "", t)


def registry_companies(candidates: DataFrame) -> DataFrame:
    """One row per lei (upper case): the most frequent facts, then the first of those, of all rows of that lei."""
    rows = candidates.filter("trim(lei) <> ''").select(
        F.upper(F.trim("lei")).alias("id"),
        name_core(F.col("legal_name")).alias("core"), business_line(F.col("legal_name")).alias("line"), legal_form(F.col("legal_name")).alias("form"),
        F.upper(F.trim("legal_address_country")).alias("country"), town_key(F.col("legal_address_city")).alias("town"),
        F.nullif(F.regexp_replace("registration_authority_entity_id", r"\D", ""), F.lit("")).alias("number"),
    )
    return rows.groupBy("id").agg(*[F.mode(c, True).alias(c) for c in ("core", "line", "form", "country", "town", "number")])


def local_companies(rows: DataFrame) -> DataFrame:
    """One row per entity_id, likewise; head and tail are the digits of its number that the note shows, and a line of business may stand there too."""
    note = fold(F.col("note"))
    r = rows.filter("trim(entity_id) <> ''").select(
        F.trim("entity_id").alias("id"),
        name_core(F.col("local_legal_name")).alias("core"),
        F.coalesce(business_line(F.col("local_legal_name")), business_line(F.when(note.startswith("djelatnost"), F.col("note")))).alias("line"),
        legal_form(F.col("local_legal_name")).alias("form"),
        F.upper(F.trim("local_country")).alias("country"), town_key(F.col("local_city")).alias("town"),
        F.nullif(F.regexp_extract(note, r"reg\. no\. (\d{3,})\?", 1), F.lit("")).alias("head"),
        F.nullif(F.regexp_extract(note, r"zavrsava na (\d{3,})", 1), F.lit("")).alias("tail"),
    )
    return r.groupBy("id").agg(*[F.mode(c, True).alias(c) for c in ("core", "line", "form", "country", "town", "head", "tail")])


ATTRIBUTES = ("line", "country", "town", "form")
#: The cascade: a pass for each number of letters left out (None: no pass), in each the attributes that both sides must state, stronger rules first. Digits that agree come before them.
PASSES: tuple[tuple[tuple[str, ...], ...], ...] = (
    (("line", "country"), ("line", "town"), ("line",), ("country", "town"), ("country",), ("town",), ()),
    (("line", "country"), ("line", "town"), ("line",), ("country", "town"), ("country",), ("town",)),
    (("line", "country"), ("line", "town"), ("country", "town")),
)
#: Letters up to which the letters left out are all tried; longer cores are cut into segments of which an equal one must remain.
DELETED_UP_TO = 60
#: Pairs of a less precise rule aren't taken, nor those of one that is only so precise by its labels.
LEAST = 0.5


def _deletions(core: Column, n: int) -> Column:
    """The core with up to n letters left out. Cores of fewer than 5 letters, or 7 for the second, are only compared as they are."""

    def less(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))

    if n == 0:
        return F.array(core)
    one = F.array_distinct(F.concat(F.array(core), F.when(F.length(core) >= 5, less(core)).otherwise(F.array().cast("array<string>"))))
    return one if n == 1 else F.array_distinct(F.concat(one, F.flatten(F.transform(one, lambda x: F.when(F.length(x) >= 7, less(x)).otherwise(F.array(x))))))


def _segments(core: str, n: int, registry: bool) -> Column:
    """Hashes of 2n + 1 segments of the core: with n letters left out on either side one of them is whole on both.

    The local side has each segment at every place where it may stand in a registry core of every possible length.
    """
    grown, moved = ("array(0)", "array(0)") if registry else (f"sequence({-n}, {n})", f"sequence({-n}, {n})")
    size = f"(length({core}) + d)"
    start, end = (f"cast(floor({size} * {i} / {2 * n + 1}) AS int)" for i in ("i", "(i + 1)"))
    one = f"xxhash64(i, {size}, substring({core}, {start} + m + 1, {end} - {start}))"
    return F.expr(f"array_distinct(flatten(flatten(transform({grown}, d -> transform(sequence(0, {2 * n}), i -> transform({moved}, m -> {one}))))))")


def pieces(name: str, n: int, registry: bool) -> Column:
    """Hashes of which two cores share one if they are the same but for n letters left out of either; lengths around DELETED_UP_TO have both kinds."""
    core = F.col(name)
    short = F.when(F.length(core) <= DELETED_UP_TO, F.transform(_deletions(core, n), lambda x: F.xxhash64(x)))
    if n == 0:
        return F.array(F.xxhash64(core))
    long = F.when(F.length(core) > DELETED_UP_TO - n, _segments(name, n, registry))
    none = F.array().cast("array<bigint>")
    return F.concat(F.coalesce(short, none), F.coalesce(long, none))


def _same_but_for(n: int) -> Column:
    """Whether two cores differ by so many letters at most; long ones are compared here, as an equal segment proves nothing."""
    a, b = F.col("g_core"), F.col("l_core")
    letters = lambda c: F.array_sort(F.split(c, ""))
    near = F.levenshtein(a, b, 2 * n) >= 0
    return near & ((F.greatest(F.length(a), F.length(b)) <= DELETED_UP_TO) | (F.levenshtein(a, b, n) >= 0) | (letters(a) == letters(b)))


def _numbers_agree() -> Column:
    """Whether the digits that both sides show agree; null where a side shows none."""
    by_head = F.when(F.col("g.number").isNotNull() & F.col("l.head").isNotNull(), F.startswith("g.number", "l.head"))
    by_tail = F.when(F.col("g.number").isNotNull() & F.col("l.tail").isNotNull(), F.endswith("g.number", "l.tail"))
    return F.coalesce(by_head & by_tail, by_head, by_tail)


def _stated_keys(rules: tuple[tuple[str, ...], ...], registry: bool) -> Column:
    """A record's keys of a pair of cores: one for each set of attributes a partner may state that satisfies a rule, of the values both would state.

    Two records share a key only if they contradict each other in no attribute, and then just one.
    """
    own = " + ".join(f"IF({c} IS NULL, 0, {1 << i})" for i, c in enumerate(ATTRIBUTES))
    keys = []
    for t in range(1 << len(ATTRIBUTES)):
        stated = [c for i, c in enumerate(ATTRIBUTES) if t >> i & 1]
        asked = [" AND ".join(["true", *[f"{c} IS NOT NULL" for c in rule]]) for rule in rules if set(rule) <= set(stated)]
        if asked:
            masks = f"{own}, {t}" if registry else f"{t}, {own}"
            keys.append(f"IF({' OR '.join(f'({x})' for x in asked)}, xxhash64({', '.join([masks, *stated])}), NULL)")
    return F.expr(f"array_compact(array({', '.join(keys)}))")


def _rule_keys(rules: tuple[tuple[str, ...], ...]) -> Column:
    """A key for each rule whose attributes the record states."""
    return F.expr(f"array_compact(array({', '.join(f'IF({' AND '.join(f'{c} IS NOT NULL' for c in rule)}, xxhash64({i}, {', '.join(rule)}), NULL)' for i, rule in enumerate(rules))}))")


def _digit_keys(registry: bool, shown: tuple[int, int]) -> Column:
    """The first and the last of the digits a record shows, as many as every local record that shows some does."""
    head, tail = ("number", "number") if registry else ("head", "tail")
    return F.expr(f"array_compact(array(IF(length({head}) >= {shown[0]}, xxhash64('head', left({head}, {shown[0]})), NULL), IF(length({tail}) >= {shown[1]}, xxhash64('tail', right({tail}, {shown[1]})), NULL)))")


def _open_records(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """The records no pair holds yet, with `rep`: of those alike in core, attributes and whether they show digits, it is the one with the least or the greatest hash."""
    done = resolved.select(F.explode(F.array(F.struct(F.lit(True).alias("registry"), F.col("lei").alias("id")), F.struct(F.lit(False).alias("registry"), F.col("entity_id").alias("id")))).alias("x")).select("x.*")
    left = records.join(done.hint("merge"), ["registry", "id"], "left_anti")
    row = F.struct(F.xxhash64("id").alias("h"), "id")
    two = left.groupBy("registry", "core", *ATTRIBUTES, F.coalesce("number", "head", "tail").isNotNull().alias("shows")).agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    reps = two.select("registry", F.explode(F.array_distinct(F.array("lo.id", "hi.id"))).alias("id"), F.lit(True).alias("rep"))
    return cut_lineage(left.join(reps.hint("merge"), ["registry", "id"], "left"))


def _core_pairs(g: DataFrame, l: DataFrame, n: int, rules: tuple[tuple[str, ...], ...], shown: tuple[int, int]) -> DataFrame:  # noqa: E741
    """(g_core, l_core): the cores that are the same but for n letters and that have records which share a rule's attributes or digits."""

    def keyed(d: DataFrame, registry: bool, name: str) -> DataFrame:
        each = d.select("core", F.explode(F.concat(_rule_keys(rules), _digit_keys(registry, shown))).alias("k"))
        each = each.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "core", "k").distinct()  # few bytes that grow a hundredfold: not to be coalesced into one task
        return each.select(F.col("core").alias(name), "k", F.explode(pieces("core", n, registry)).alias("piece")).select(name, F.xxhash64("piece", "k").alias("h"))

    return keyed(g, True, "g_core").join(keyed(l, False, "l_core").hint("merge"), "h").select("g_core", "l_core").distinct().filter(_same_but_for(n))


def _candidates(g: DataFrame, l: DataFrame, n: int, rules: tuple[tuple[str, ...], ...], shown: tuple[int, int]) -> DataFrame:  # noqa: E741
    """(lei, entity_id, agree, rule, edits, alike) of the pairs that meet and contradict each other in nothing but digits.

    rule is the number of the first rule whose attributes both state, null if there is none. Only ids and hashes are exploded and
    shuffled; the attributes join the pairs after.
    """
    cores = cut_lineage(_core_pairs(g, l, n, rules, shown)) if n else None

    def keyed(d: DataFrame, registry: bool, name: str) -> DataFrame:
        own, pair = ("g_core" if registry else "l_core"), ("g_core", "l_core") if n else ("core",)
        rows = d.join(cores.hint("merge"), F.col("core") == F.col(own)) if n else d
        keys = F.concat(F.when(F.col("rep"), _stated_keys(rules, registry)).otherwise(F.array().cast("array<bigint>")), _digit_keys(registry, shown))
        return rows.select("id", *pair, F.explode(keys).alias("k")).select(F.col("id").alias(name), F.xxhash64(*pair, "k").alias("h"))

    pairs = keyed(g, True, "lei").join(keyed(l, False, "entity_id").hint("merge"), "h").select("lei", "entity_id").distinct()
    both = pairs.join(g.alias("g").hint("merge"), F.col("g.id") == F.col("lei")).join(l.alias("l").hint("merge"), F.col("l.id") == F.col("entity_id"))
    for k in ATTRIBUTES:
        both = both.filter(F.coalesce(F.col(f"g.{k}") == F.col(f"l.{k}"), F.lit(True)))
    equal = {k: F.coalesce(F.col(f"g.{k}") == F.col(f"l.{k}"), F.lit(False)).cast("int") for k in ATTRIBUTES}
    rule = F.coalesce(*[F.when(sum((equal[k] for k in keys), F.lit(0)) == len(keys), F.lit(i)) for i, keys in enumerate(rules, start=1)])
    edits = F.when(F.col("g.core") == F.col("l.core"), 0).otherwise(F.levenshtein(F.col("g.core"), F.col("l.core"), 2 * n))
    return both.select("lei", "entity_id", _numbers_agree().alias("agree"), rule.alias("rule"), edits.alias("edits"), sum(equal.values(), F.lit(0)).alias("alike"))


def _mutual(p: DataFrame, rank: Column) -> DataFrame:
    """(lei, entity_id, rule, agree) of the pairs that are each other's only best by `rank`.

    Of the best partners the one with the greatest and the one with the least hash are kept; only if that is one
    partner is it the only best.
    """
    p = p.withColumn("rank", rank)

    def best(key: str, other: str) -> DataFrame:
        h = F.xxhash64(other)
        top = p.groupBy(key).agg(F.max(F.struct("rank", h.alias("h"), other, "rule", "agree")).alias("hi"), F.max(F.struct("rank", F.bitwise_not(h).alias("h"), other)).alias("lo"))
        return top.filter(F.col(f"hi.{other}") == F.col(f"lo.{other}")).select(key, F.col(f"hi.{other}").alias(other), *[F.col(f"hi.{c}").alias(c) for c in (("rule", "agree") if key == "lei" else ())])

    return best("lei", "entity_id").join(best("entity_id", "lei").hint("merge"), ["lei", "entity_id"])


def _precisions(p: DataFrame, least: float) -> dict[int, float]:
    """rule -> precision of the pairs it would choose without digits, if that is enough; 0 stands for the digits themselves.

    Digits that agree are as sure as the attributes of such pairs say: a pair that nothing else supports counts against them.
    """
    blind = _mutual(p.filter("rule IS NOT NULL"), F.struct((-F.col("rule")).alias("r"), (-F.col("edits")).alias("e"), "alike"))
    told = blind.groupBy("rule").agg(F.count_if(F.col("agree")).alias("yes"), F.count_if(~F.col("agree")).alias("no"))
    said = {r.rule: (r.yes, r.no) for r in told.unionByName(p.filter("agree").select(F.lit(0).alias("rule"), "alike").groupBy("rule").agg(F.count_if(F.col("alike") > 0).alias("yes"), F.count_if(F.col("alike") == 0).alias("no"))).collect()}
    precision = {k: (yes + 1) / (yes + no + 2) for k, (yes, no) in sorted(said.items())}
    return {k: v for k, v in precision.items() if v > least or (v == least and not said[k][1])}


def match(candidates: DataFrame, reviews: DataFrame, passes: tuple = PASSES, least: float = LEAST) -> DataFrame:
    """(lei, entity_id, rule, confidence): each registry record and local company that are the same, at most one pair for either.

    `candidates` and `reviews` are tables like gleif_candidates and gleif_review_rows. Several rows of an
    lei or an entity_id are one record with the most frequent value of each attribute (of ties the least). Nulls and
    blanks say nothing: they never agree and never contradict; a record without a name's core has no pair. Two
    records equally alike to a third are left open. An empty table gives no pairs.
    """
    g, l = registry_companies(candidates).withColumn("registry", F.lit(True)), local_companies(reviews).withColumn("registry", F.lit(False))  # noqa: E741
    records = cut_lineage(g.unionByName(l, allowMissingColumns=True).filter("core IS NOT NULL"))
    shown = tuple(n or 0 for n in records.agg(F.min(F.length("head")), F.min(F.length("tail"))).first())
    resolved = candidates.sparkSession.sql("SELECT '' AS lei, '' AS entity_id, '' AS rule, 0D AS confidence WHERE false")
    for n, rules in enumerate(passes):
        if not rules:
            continue
        rest = _open_records(records, resolved)
        p = cut_lineage(_candidates(rest.filter("registry"), rest.filter("NOT registry"), n, rules, shown))
        sure = _precisions(p, least)
        names = ["digits", *[" ".join(keys) for keys in rules]]
        by = F.when(F.col("agree"), 0).otherwise(F.col("rule"))
        taken = p.filter("agree IS NULL OR agree").withColumn("rule", by).filter(F.col("rule").isin(list(sure)))
        told = F.create_map(*[F.lit(x) for k, v in sure.items() for x in (k, F.struct(F.lit(" ".join(filter(None, [f"core~{n}" if n else "core", names[k]]))).alias("rule"), F.lit(v).alias("confidence")))]) if sure else None
        if sure:
            rank = F.struct((-F.col("rule")).alias("r"), (-F.col("edits")).alias("e"), "alike")
            new = _mutual(taken, rank).select("lei", "entity_id", told[F.col("rule")].alias("x")).select("lei", "entity_id", "x.rule", "x.confidence")
            resolved = cut_lineage(resolved.unionByName(new))
    return resolved
