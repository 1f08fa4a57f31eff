"""Information-theoretic sanitisation: personal data, and the terms around it that give it away.

Protected entities are e-mail addresses, IPv4 addresses, payment cards and phone numbers, found by patterns. A term
(a word of letters) anywhere in a document with an entity discloses it as far as it tells the entity from others:
with documents as observations,

    PMI(t; e) = log2(N * df(t, e) / (df(t) * df(e))),   IC(e) = log2(N / df(e)),   disclosure = PMI / IC,

where df(t) counts the documents with t, df(e) those with e, df(t, e) those with both. A disclosure of 1 means that
whoever sees t knows e. From 0.9 on a term is removed, from 0.75 generalised, wherever it stands in the documents that
hold that entity; what rests on fewer than two documents is no estimate and is left. Terms are read with all accepted
spans blanked. Documents without protected entities stay as they are.

A term is generalised to a broader one that the corpus knows: beside e, b is broader than t if at least 0.8 of the
documents with e hold b, more documents hold b than t, and b discloses e less than 0.75. Of these the most informative
one, that of the fewest documents, takes the term's place, and [TERM] where there is none.

All expressions are Spark's own. Positions are code points, end exclusive; they come from the lengths of the pieces
between matches, so the work is linear in the text. The patterns are possessive, so long runs need no stack.

Defined cases: null and empty texts have no spans. Rows that repeat doc_id and text count once in the statistics and
all get the same spans. A null doc_id is an id like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import freed, quoted, staged

SUPPORT = 2
GENERALISE, REMOVE = 0.75, 0.9
#: Share of an entity's documents that hold a broader term.
SUBSUMED = 0.8
#: Candidate terms, and bytes of spans or terms of documents, broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_TERMS, BROADCAST_BYTES = 500_000, 16 << 20

#: Kinds in order, each with its pattern. A match starts where the run of its first class starts, or where the
#: previous match ended: any other start in the run would fail as the first one does.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"(?<![^\s(\[\x22'])\p{L}{3,}+(?=[.,;:!?)\]\x22']*+(?:\s|$))"
_SPAN = "array<struct<start:int,end:int,value:string>>"
_TOLD = "array<struct<start:int,end:int,disclosure:double,broader:string>>"


def _passes(kind: str) -> str:
    """Whether the match x.hit counts."""
    return {
        "email": "true",
        "ip": r"forall(split(x.hit, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
        "card": "length(translate(x.hit, ' -', '')) BETWEEN 16 AND 19 AND luhn_check(translate(x.hit, ' -', ''))",
        "phone": "length(regexp_replace(x.hit, '[^0-9]', '')) BETWEEN 8 AND 15",
    }[kind]


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _spans(text: str, kind: str) -> str:
    """array of (start, end, value) of the matches of one kind that count."""
    p = _quoted(KINDS[kind])
    hits, gaps = f"regexp_extract_all({text}, '{p}', 0)", f"split({text}, '{p}', -1)"
    at = "s.at + length(x.gap)"
    span = f"named_struct('start', {at}, 'end', {at} + length(x.hit), 'value', x.hit)"
    step = f"named_struct('at', {at} + length(x.hit), 'found', if({_passes(kind)}, concat(s.found, array({span})), s.found))"
    pieces = f"transform(h, (hit, i) -> named_struct('hit', hit, 'gap', get(g, i)))"
    folded = f"aggregate({pieces}, named_struct('at', 0, 'found', cast(array() AS {_SPAN})), (s, x) -> {step}, s -> s.found)"
    return f"get(transform(array({hits}), h -> if(size(h) = 0, cast(array() AS {_SPAN}), get(transform(array({gaps}), g -> {folded}), 0))), 0)"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), one array of spans a kind, and words (its distinct terms), for every row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    may = {"email": "instr(text, '@') > 0", "ip": "true", "card": "true", "phone": "instr(text, '+') > 0"}
    spans = [F.expr(f"CASE WHEN {may[k]} THEN {_spans('text', k)} ELSE cast(array() AS {_SPAN}) END").alias(k) for k in KINDS]
    found = texts.select("doc_id", F.xxhash64("text").alias("row"), "text", *spans).withColumn("blanked", _blanked())
    words = F.expr(f"array_distinct(transform(regexp_extract_all(blanked, '{_quoted(TERM)}', 0), x -> lower(x)))")
    return found.select("doc_id", "row", *KINDS, words.alias("words"))


def _blanked() -> Column:
    """text with the spans of all kinds replaced by as many spaces; spans may overlap."""
    spans = f"array_sort(concat({', '.join(f'transform({k}, x -> struct(x.start, x.end))' for k in KINDS)}))"
    step = "if(x.end > s.at, named_struct('at', x.end, 'cut', concat(s.cut, array(named_struct('from', s.at, 'start', greatest(x.start, s.at), 'end', x.end)))), s)"
    cut = f"aggregate({spans}, named_struct('at', 0, 'cut', cast(array() AS array<struct<from:int,start:int,end:int>>)), (s, x) -> {step})"
    whole = "concat(array_join(flatten(transform(c.cut, x -> concat(slice(l, x.from + 1, x.start - x.from), array(repeat(' ', x.end - x.start))))), ''), array_join(slice(l, c.at + 1, size(l)), ''))"
    none = " AND ".join(f"size({k}) = 0" for k in KINDS)
    return F.expr(f"CASE WHEN {none} THEN text ELSE get(transform(array({cut}), c -> get(transform(array(split(text, '')), l -> {whole}), 0)), 0) END")


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind == "email" else value if kind == "ip" else F.regexp_replace(value, "[^0-9]", "")
    return F.concat(F.lit(f"{kind}:"), plain)


def _places() -> Column:
    """(start, end, disclosure, broader) of every occurrence in `blanked` of the terms of the map `told`, in order."""
    p = _quoted(TERM)
    here = "s.at + length(x.gap)"
    hit = f"named_struct('start', {here}, 'end', {here} + length(x.hit), 'disclosure', told[lower(x.hit)].disclosure, 'broader', told[lower(x.hit)].broader)"
    step = f"named_struct('at', {here} + length(x.hit), 'found', if(map_contains_key(told, lower(x.hit)), concat(s.found, array({hit})), s.found))"
    pieces = "transform(h, (hit, i) -> named_struct('hit', hit, 'gap', get(g, i)))"
    folded = f"aggregate({pieces}, named_struct('at', 0, 'found', cast(array() AS {_TOLD})), (s, x) -> {step}, s -> s.found)"
    return F.expr(f"get(transform(array(regexp_extract_all(blanked, '{p}', 0)), h -> get(transform(array(split(blanked, '{p}', -1)), g -> {folded}), 0)), 0)")


def _entities(found: DataFrame) -> DataFrame:
    """doc_id, row and the distinct entities of each document that has any, once for rows that repeat id and text."""
    def values(kind: str) -> Column:
        return F.transform(kind, lambda x: _entity(kind, x["value"]))

    every = F.concat(*[values(k) for k in KINDS])
    some = found.filter(" OR ".join(f"size({k}) > 0" for k in KINDS))
    return some.select("doc_id", "row", F.explode(F.array_distinct(every)).alias("entity"), "words").dropDuplicates(["doc_id", "row", "entity"])


def contexts(found: DataFrame) -> DataFrame:
    """doc_id, row, entity, term of the terms that share a document with an entity.

    Entities and terms that stand in fewer than SUPPORT documents are left out, and so are terms in too many of them:
    as df(t, e) <= df(e), a disclosure of GENERALISE takes df(t) <= N ** (1 - GENERALISE) * df(e) ** GENERALISE.
    """
    mentions = staged(_entities(found))
    n = found.select("doc_id", "row").distinct().count()
    shared = staged(mentions.groupBy("entity").agg(F.count("*").alias("with_entity")).filter(F.col("with_entity") >= SUPPORT))
    few = shared.count() <= BROADCAST_TERMS
    mentions = staged(mentions.join(F.broadcast(shared) if few else shared, "entity"))
    once = mentions.groupBy("doc_id", "row").agg(F.first("words").alias("words"))
    terms = once.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("at_least")).filter(F.col("at_least") >= SUPPORT)
    most = F.lit(float(max(n, 1)) ** (1 - GENERALISE) * (1 + 1e-9)) * F.pow("with_entity", F.lit(GENERALISE))
    widest = mentions.agg(F.max(most)).first()[0] or 0.0
    terms = staged(terms.filter(F.col("at_least") <= widest))
    few = terms.count() <= BROADCAST_TERMS
    # the bounded terms of a document meet its entities once, as two lists
    kept = once.select("doc_id", "row", F.explode("words").alias("term")).join(F.broadcast(terms) if few else terms, "term")
    kept = kept.groupBy("doc_id", "row").agg(F.collect_list(F.struct("term", "at_least")).alias("terms"))
    kept = kept.select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), "terms")
    own = mentions.groupBy("doc_id", "row").agg(F.collect_list(F.struct("entity", most.alias("most"))).alias("entities"))
    both = own.join(kept, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("row") == F.col("__row")))
    pairs = both.select("doc_id", "row", F.inline("entities"), "terms")
    pairs = pairs.select("doc_id", "row", "entity", F.explode(F.expr("filter(terms, t -> t.at_least <= most)")).alias("t"))
    return pairs.select("doc_id", "row", "entity", "t.term")


def _weighted(found: DataFrame) -> DataFrame:
    """words with the weight of each row: one over the number of rows that repeat its id and text."""
    again = staged(found.groupBy("doc_id", "row").agg(F.count("*").alias("rows")).filter("rows > 1"))
    n = again.count()
    if not n:
        return found.select("words", F.lit(1.0).alias("weight"))
    again = again.select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), "rows")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("row") == F.col("__row"))
    both = found.select("doc_id", "row", "words").join(F.broadcast(again) if n <= BROADCAST_TERMS else again, same, "left")
    return both.select("words", F.coalesce(1 / F.col("rows"), F.lit(1.0)).alias("weight"))


def _disclosure(n: int) -> Column:
    """PMI over IC from the columns both, with_term and with_entity."""
    pmi = F.log2(F.lit(float(n)) * F.col("both") / (F.col("with_term") * F.col("with_entity")))
    ic = F.log2(F.lit(float(n)) / F.col("with_entity"))
    return F.when(ic > 0, pmi / ic)


def _with_term(found: DataFrame, terms: DataFrame) -> DataFrame:
    """term, with_term: the documents that hold each of the given terms, rows that repeat counted once."""
    few = terms.count() <= BROADCAST_TERMS
    seen = _weighted(found).select("weight", F.explode("words").alias("term"))
    seen = seen.join(F.broadcast(terms) if few else terms, "term", "left_semi")
    return seen.groupBy("term").agg(F.round(F.sum("weight")).alias("with_term"))


def disclosures(docs: DataFrame, found: DataFrame, near: DataFrame) -> DataFrame:
    """entity, term, disclosure of the pairs that rest on SUPPORT documents and reach GENERALISE, with their counts."""
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("both")).filter(F.col("both") >= SUPPORT)
    pairs = staged(pairs)

    entities = _entities(found).groupBy("entity").agg(F.count("*").alias("with_entity"))
    candidates = staged(pairs.select("term").distinct())
    n = found.select("doc_id", "row").distinct().count()
    rated = pairs.join(staged(_with_term(found, candidates)), "term").join(staged(entities), "entity")
    rated = rated.select("entity", "term", _disclosure(n).alias("disclosure"), "both", "with_term", "with_entity")
    return staged(rated.filter(F.col("disclosure") >= GENERALISE))


def broader_terms(found: DataFrame, rated: DataFrame) -> DataFrame:
    """entity, term, broader of the rated pairs below REMOVE that have a broader term."""
    some = rated.filter(F.col("disclosure") < REMOVE).select("entity", "term", F.col("with_term").alias("with_narrow"), "with_entity")
    entities = staged(some.select("entity", "with_entity").distinct())
    beside = _entities(found).join(entities, "entity").select("entity", "with_entity", F.explode("words").alias("term"))
    beside = beside.groupBy("entity", "with_entity", "term").agg(F.count("*").alias("both"))
    beside = staged(beside.filter(F.col("both") >= SUBSUMED * F.col("with_entity")))
    n = found.select("doc_id", "row").distinct().count()
    wide = beside.join(_with_term(found, staged(beside.select("term").distinct())), "term")
    wide = wide.filter(F.coalesce(_disclosure(n), F.lit(0.0)) < GENERALISE).select("entity", F.col("term").alias("broader"), "with_term")
    rows = some.join(wide, "entity").filter((F.col("with_term") > F.col("with_narrow")) & (F.col("broader") != F.col("term")))
    out = staged(rows.groupBy("entity", "term").agg(F.min(F.struct("with_term", "broader"))["broader"].alias("broader")))
    freed(entities, beside)
    return out


def _small(df: DataFrame, column: str) -> bool:
    return (df.agg(F.sum(F.length(F.to_json(column)))).first()[0] or 0) <= BROADCAST_BYTES


def find(docs: DataFrame, generalise: bool = False) -> DataFrame:
    """doc_id, row, the spans of each kind, and terms: array of (start, end, disclosure, broader) in order, for every row.

    Broader terms are looked for on demand; they are null otherwise, and where there is none.
    """
    found = staged(detect(docs))
    near = staged(contexts(found))
    rated = disclosures(docs, found, near)
    known = rated.select("entity", "term", "disclosure")
    known = known.join(broader_terms(found, rated), ["entity", "term"], "left") if generalise else known.withColumn("broader", F.lit(None).cast("string"))
    told = near.join(known, ["entity", "term"])
    told = told.groupBy("doc_id", "row", "term").agg(F.max(F.struct("disclosure", "broader")).alias("worst"))
    told = told.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("term", "worst"))).alias("told"))
    told = staged(told.select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), "told"))
    freed(near, rated)
    few = _small(told, "told")
    told = F.broadcast(told) if few else told
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("row") == F.col("__row"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("row", F.xxhash64("text")).join(told, same).select("__doc", "__row", "text", "told").dropDuplicates(["__doc", "__row"])
    places = found.join(texts, same).dropDuplicates(["__doc", "__row"]).withColumn("blanked", _blanked())
    places = staged(places.select("__doc", "__row", _places().alias("terms")))
    both = found.join(F.broadcast(places) if few and _small(places, "terms") else places, same, "left").drop("__doc", "__row", "words")
    return both.withColumn("terms", F.coalesce("terms", F.expr(f"cast(array() AS {_TOLD})")))


def listed(*kinds: str) -> Column:
    """kind:start:end of the spans of the kinds, in the given order, comma-joined."""

    def one(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind.removesuffix("s")), x["start"], x["end"]))

    return F.array_join(F.concat(*[one(k) for k in kinds]), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with protected entities masked and disclosing terms removed or generalised; n_chars follows where it is there.

    All other columns come out as they are, whatever their names: the input's columns travel as one. A text with spans is
    cut into one string a code point while it is put together, so a task holds some fifty times its longest such text.
    """
    mask = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("put")))
    told = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["disclosure"] >= REMOVE, "").otherwise(F.coalesce(x["broader"], F.lit("[TERM]"))).alias("put")))
    spans = find(docs, generalise=True).select(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row"), F.array_sort(F.concat(*[mask(k) for k in KINDS], told)).alias("spans"))
    spans = staged(spans.filter("size(spans) > 0").dropDuplicates(["of_id", "of_row"]))
    few = _small(spans, "spans")
    whole_row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    keyed = docs.select(whole_row.alias("given"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("plain"))
    rows = keyed.join(F.broadcast(spans) if few else spans, F.col("id").eqNullSafe(F.col("of_id")) & (F.xxhash64("plain") == F.col("of_row")), "left")
    # spans may overlap: each takes what those before it left
    step = "if(x.end > s.at, named_struct('at', x.end, 'cut', concat(s.cut, array(named_struct('from', s.at, 'start', greatest(x.start, s.at), 'put', if(x.start >= s.at, x.put, ''))))), s)"
    cut = f"aggregate(spans, named_struct('at', 0, 'cut', cast(array() AS array<struct<from:int,start:int,put:string>>)), (s, x) -> {step})"
    whole = "concat(array_join(flatten(transform(c.cut, x -> concat(slice(l, x.from + 1, x.start - x.from), array(x.put)))), ''), array_join(slice(l, c.at + 1, size(l)), ''))"
    text = F.expr(f"CASE WHEN spans IS NOT NULL THEN get(transform(array({cut}), c -> get(transform(array(split(plain, '')), l -> {whole}), 0)), 0) END")
    rows = rows.withColumn("clean", text)
    none = F.col("spans").isNull()
    out = {c: F.col("given").getField(c) for c in docs.columns}
    for c in docs.columns:
        if c.lower() == "text":
            out[c] = F.when(none, out[c]).otherwise(F.col("clean"))
        elif c.lower() == "n_chars":
            out[c] = F.when(none, out[c]).otherwise(F.length("clean"))
    return rows.select(*[v.alias(c) for c, v in out.items()])
