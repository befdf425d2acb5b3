"""Information-theoretic sanitisation. DataFrame functions only.

Personal data found by pattern are the protected entities.  For each word of a
text with an entity, wherever it stands, corpus co-occurrence says how much of
the entity's information the word gives away: pointwise mutual information over
the entity's information content, in numbers of distinct texts.  Words beyond
the upper threshold are removed in the texts that hold the entity.  Words beyond
the lower one are generalised: to the class of all words with the same first
letters where that class does not disclose the entity by the same measure, else
to the class of all words or all numbers.  The entities themselves are replaced
by their kind.

All array work is linear in a text: running state over an array is kept by
``_scan``, and arrays are bound to lambda variables, since what a lambda only
refers to would be computed again for each of its elements.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm import _store

#: Patterns of the base kinds, in the order of the contract. Possessive and anchored forms of
#: email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`, ip `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`
#: and card `[0-9]([\x20-]?[0-9])+`: they match the same, without stepping back over long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to match any of them: most texts are read once only.
ANY = r"@|\+[0-9]|[0-9]\.[0-9]|(?:[0-9][\x20-]?+){14}"
KINDS = [*PATTERNS, "generalised", "removed"]
#: shown: what stands in the span's place in the clean text.
SPAN = "struct<start: int, rank: int, stop: int, kind: string, value: string, shown: string>"
NONE = f"CAST(array() AS array<{SPAN}>)"
WORD = r"[\p{L}\p{M}\p{N}]+"
STEM = 3
CHUNK = 4096


@dataclass(frozen=True)
class Params:
    """support: distinct texts in which word and entity must meet. generalise, remove: thresholds of
    disclosure (1: the word tells the entity). broadcast_rows: up to this many rows a table is broadcast."""

    support: int = 3
    generalise: float = 0.85
    remove: float = 0.97
    broadcast_rows: int = 200_000


def _sql(text: str) -> str:
    return "r'" + text.replace("'", "\\'") + "'"


def _bind(value: str, name: str, body: str) -> str:
    """SQL of body, in which ``name`` is the value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(items: str, state: str, after: str, out: str, kind: str) -> str:
    """SQL of an array of ``kind``: ``out`` for each x of items under a running state s that begins as ``state`` and goes on as ``after``.

    Appending copies an array, so it is done in blocks of 128."""
    step = f"aggregate(block, named_struct('s', run.s, 'o', CAST(array() AS array<{kind}>)), (acc, x) -> {_bind('acc.s', 's', f"named_struct('s', {after}, 'o', array_append(acc.o, {out}))")})"
    blocks = f"transform(sequence(0, greatest(size(items) - 1, 0) div 128), b -> slice(items, b * 128 + 1, 128))"
    joined = _bind(step, "done", "named_struct('s', done.s, 'o', array_append(run.o, done.o))")
    return _bind(items, "items", f"flatten(aggregate({blocks}, named_struct('s', {state}, 'o', CAST(array() AS array<array<{kind}>>)), (run, block) -> {joined}, run -> run.o))")


def _spans(text: str, pattern: str, kind: str, rank: int, shown: str) -> str:
    """SQL of the spans (code points) of all matches, placed by the pieces between them."""
    found = f"zip_with(transform(slice(split({text}, {_sql(pattern)}, -1), 1, size(found)), piece -> length(piece)), found, (gap, v) -> named_struct('gap', gap, 'v', v))"
    span = f"named_struct('start', s + x.gap, 'rank', {rank}, 'stop', s + x.gap + length(x.v), 'kind', '{kind}', 'value', x.v, 'shown', '{shown}')"
    return _bind(f"regexp_extract_all({text}, {_sql(pattern)}, 0)", "found", f"IF(size(found) = 0, {NONE}, {_scan(found, '0', 's + x.gap + length(x.v)', span, SPAN)})")


_LUHN = """aggregate(sequence(1, length(d)), 0, (t, i) -> t + CASE
    WHEN (length(d) - i) % 2 = 0 THEN CAST(substr(d, i, 1) AS INT)
    WHEN CAST(substr(d, i, 1) AS INT) > 4 THEN 2 * CAST(substr(d, i, 1) AS INT) - 9
    ELSE 2 * CAST(substr(d, i, 1) AS INT) END) % 10 = 0"""
_VALID = {
    "email": "true",
    "ip": "forall(split(m.value, '[.]'), x -> length(ltrim('0', x)) <= 3 AND CAST(concat('0', substr(ltrim('0', x), 1, 3)) AS INT) <= 255)",
    "card": _bind("regexp_replace(m.value, '[^0-9]', '')", "d", f"CASE WHEN length(d) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END"),
    "phone": "length(regexp_replace(m.value, '[^0-9]', '')) BETWEEN 10 AND 15",
}


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _keys(first: str = "k1", second: str = "k2") -> list[Column]:
    return [F.xxhash64(_text()).alias(first), F.xxhash64(_text(), F.lit(1)).alias(second)]


def find_entities(docs: DataFrame) -> DataFrame:
    """docs with ``base`` added: valid spans of the base kinds, by start and kind."""
    text = "coalesce(CAST(text AS STRING), '')"
    found = [f"filter({_spans(text, pattern, kind, rank, f'[{kind}]')}, m -> {_VALID[kind]})" for rank, (kind, pattern) in enumerate(PATTERNS.items())]
    return docs.withColumn("base", F.expr(f"IF({text} rlike {_sql(ANY)}, sort_array(concat({', '.join(found)})), {NONE})"))


def _stem(term: str) -> str:
    return f"concat(left({term}, {STEM}), '*')"


def _disclosing(rows: DataFrame, texts: float, both: Column, least: float) -> DataFrame:
    """rows with the disclosure of with_entity texts by with_term texts that meet in ``both``, where it reaches ``least``."""
    share = F.log2(F.lit(texts) / F.col("with_entity"))
    gain = F.log2(F.lit(texts) * both / (F.col("with_entity") * F.col("with_term")))
    return rows.withColumn("disclosure", F.when(share > 0, gain / share).otherwise(F.lit(0.0))).where(F.col("disclosure") >= least)


def _counted(rows: DataFrame, column: str, least: int, count: str, label: str) -> DataFrame:
    return _store.save(rows.groupBy(column).agg(F.count("*").alias(count)).where(F.col(count) >= least), label)


def _scored(docs: DataFrame, met: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Rows (entity, term, shown) of words that disclose an entity, and the entities and words of the texts of met, as far as they have support.

    Words are those of whole texts, in the joint counts as in the single ones."""
    again = _store.save(docs.select(*_keys()).groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1"), "copied-texts")
    texts = float(docs.count() - (again.agg(F.sum(F.col("n") - 1)).first()[0] or 0))
    again = again.select("k1", "k2")
    # Word and entity meet in no more texts than hold the entity.
    each = met.select("k1", "k2", F.explode("entities").alias("entity"))
    entities = _counted(each, "entity", p.support, "with_entity", "entities")
    if not entities.take(1):
        return None
    held = _store.save(each.join(_store.small(entities), "entity"), "held-entities")
    spoken = met.join(held.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", F.explode("words").alias("term"))
    near = _counted(met.select(F.explode("words").alias("term")), "term", p.support, "with_term", "held-words")
    said = spoken.join(_store.small(near), "term")
    # A word stands in no fewer texts than in those with entities, and meets an entity in no more than hold either: what falls short by these falls short by the counts.
    joint = _disclosing(held.join(said, ["k1", "k2"]), texts, F.least("with_entity", "with_term"), p.generalise)
    joint = joint.groupBy("entity", "term").agg(F.count("*").alias("both"), F.min("with_entity").alias("with_entity"), F.min("with_term").alias("with_term")).where(F.col("both") >= p.support)
    joint = _store.save(_disclosing(joint, texts, F.col("both"), p.generalise).select("entity", "term", "both", "with_entity"), "joint")
    if not joint.take(1):
        return None
    words = _disclosing(joint.join(_alone(docs, joint.select("term").distinct(), "word", again, p), "term"), texts, F.col("both"), p.generalise)
    words = _store.save(words.select("entity", "term", "with_entity", "disclosure", F.expr(_stem("term")).alias("stem")), "words")
    # Only words that are not removed need a class, so few first letters are counted.
    stems = _store.save(words.where(F.col("disclosure") < p.remove).select("entity", "with_entity", "stem").distinct(), "stems")
    if stems.take(1):
        known = stems.withColumnRenamed("stem", "term")
        begun = met.select("k1", "k2", F.explode(F.array_distinct(F.expr(f"transform(words, word -> {_stem('word')})"))).alias("term"))
        begun = held.drop("with_entity").join(begun.join(_store.small(known.select("term").distinct()), "term", "left_semi"), ["k1", "k2"]).join(known, ["entity", "term"])
        begun = begun.groupBy("entity", "term").agg(F.count("*").alias("both"), F.min("with_entity").alias("with_entity"))
        begun = begun.join(_alone(docs, known.select("term").distinct(), _stem("word"), again, p), "term")
        telling = _disclosing(begun, texts, F.col("both"), p.generalise).select("entity", F.col("term").alias("stem"), F.lit(True).alias("telling"))
        words = words.join(telling, ["entity", "stem"], "left")
    else:
        words = words.withColumn("telling", F.lit(None).cast("boolean"))
    kind = F.when(F.col("term").rlike(r"^\p{N}+$"), F.lit("[number]")).otherwise(F.lit("[word]"))
    shown = F.when(F.col("disclosure") >= p.remove, F.lit("")).when(F.col("telling").isNull(), F.col("stem")).otherwise(kind)
    return _store.save(words.select("entity", "term", shown.alias("shown")), "disclosing"), held, said


def _alone(docs: DataFrame, terms: DataFrame, of: str, again: DataFrame, p: Params) -> DataFrame:
    """term, with_term: in how many distinct texts each of terms is ``of`` some word.

    again (k1, k2): the texts with copies. All others count by the row, which is
    combined before the shuffle; where those with copies are too many to be
    broadcast, every text is told apart."""
    few = _store.small(again, p.broadcast_rows)
    keyed = docs.select(*_keys(), _text().alias("text"))
    if few is not again:
        keyed = keyed.join(few.withColumn("copied", F.lit(True)), ["k1", "k2"], "left").select(F.when(F.col("copied"), F.col("k1")).alias("k1"), F.when(F.col("copied"), F.col("k2")).alias("k2"), "text")
    each = keyed.select("k1", "k2", F.explode(F.expr(f"array_distinct(transform(array_distinct(regexp_extract_all(lower(text), {_sql(WORD)}, 0)), word -> {of}))")).alias("term"))
    needed = _store.small(_store.save(terms, "needed"), p.broadcast_rows)
    if of == "word":  # there are few first letters, so all of these are counted and their share in the work stays what it is
        each = each.join(needed, "term", "left_semi")
    counted = each.groupBy("term", "k1", "k2").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum(F.when(F.col("k1").isNull(), F.col("n")).otherwise(1)).alias("with_term"))
    return _store.save(counted if of == "word" else counted.join(needed, "term"), "alone")  # a semi-join would be pushed below the count


def _disclosed(docs: DataFrame, p: Params) -> DataFrame | None:
    """Rows (k1, k2, more): for texts that hold an entity, the spans of the words that disclose it, none of which meets a base span."""
    found = find_entities(docs.select(F.col("text").cast("string").alias("text"))).where("size(base) > 0")
    named = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    words = F.array_distinct(F.regexp_extract_all(F.lower(_text()), F.lit(WORD), F.lit(0)))
    held = _store.save(found.select(*_keys(), F.monotonically_increasing_id().alias("row"), named.alias("entities"), words.alias("words"), "text", "base"), "contexts")
    copies = _store.small(_store.save(held.groupBy("k1", "k2").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies"))
    met = held.join(copies, ["k1", "k2"], "left").where("first IS NULL OR first = row")
    scored = _scored(docs, met, p)
    if scored is None:
        return None
    telling, known, said = scored
    here = said.select("k1", "k2", "term").join(_store.small(telling), "term").join(known.select("k1", "k2", "entity"), ["k1", "k2", "entity"])
    # Of several generalisations of a word in a text the widest holds.
    width = F.when(F.col("shown") == "", 0).when(F.col("shown").startswith("["), 1).otherwise(2)
    here = here.groupBy("k1", "k2", "term").agg(F.min(F.struct(width.alias("width"), "shown")).alias("w")).select("k1", "k2", "term", "w.shown")
    here = _store.save(here, "terms")
    some = _store.save(met.join(_store.small(here.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi").select("k1", "k2", "text", "base"), "telling-texts")
    spans = some.select("k1", "k2", F.expr(f"inline({_spans('text', WORD, 'generalised', 4, '')})")).drop("shown")
    spans = spans.withColumn("term", F.lower("value")).join(_store.small(here), ["k1", "k2", "term"])
    removed = F.col("shown") == ""
    spans = spans.select("k1", "k2", "start", F.when(removed, 5).otherwise(4).alias("rank"), "stop", F.when(removed, "removed").otherwise("generalised").alias("kind"), "value", "shown")
    rows = spans.unionByName(some.select("k1", "k2", F.inline("base")))
    base, own = F.col("rank") < 4, Window.partitionBy("k1", "k2")
    before = F.max(F.when(base, F.col("stop"))).over(own.orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(own.orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0))
    free = rows.withColumns({"_before": before, "_after": after}).where("rank >= 4 AND coalesce(_before <= start, true) AND coalesce(_after >= stop, true)")
    return _store.save(free.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "stop", "kind", "value", "shown"))).alias("more")), "more")


def _clean() -> str:
    """SQL of the text with spans replaced, put together from the parts between them; parts are taken from chunks, since a place in a long text is found by reading up to it."""
    part = f"array_join(transform(sequence(%(a)s div {CHUNK}, (%(b)s - 1) div {CHUNK}), c -> substr(chunks[c], greatest(%(a)s - c * {CHUNK}, 0) + 1, least(%(b)s - c * {CHUNK}, {CHUNK}) - greatest(%(a)s - c * {CHUNK}, 0))), '')"
    gap = lambda a, b: f"IF({a} >= {b}, '', {part % {'a': a, 'b': b}})"
    parts = _scan("spans", "0", "greatest(s, x.stop)", f"concat({gap('s', 'x.start')}, x.shown)", "string")
    whole = f"concat(array_join({parts}, ''), {_bind('array_max(transform(spans, x -> x.stop))', 'last', _bind('length(text)', 'n', gap('last', 'n')))})"
    return f"CASE WHEN size(spans) = 0 THEN text ELSE {_bind(f'regexp_extract_all(text, {_sql(f"(?s).{{1,{CHUNK}}}")}, 0)', 'chunks', whole)} END"


def sanitise(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """docs with ``base`` and ``spans`` (all, by start and kind) and ``clean`` (the sanitised text) added.

    Offsets count code points.  Null texts have no spans and a null clean text;
    empty ones have none.  Words are runs of letters, marks and digits of any
    length.  A word span never overlaps a base span; base spans of several kinds
    may, and then each leaves its mark.  Of words that disclose several entities
    of a text the widest generalisation holds.  Rows are kept one for one and
    counts are over distinct texts, so that copies add no evidence.  A very long
    text is handled whole, in time that grows with its length.  Columns of docs
    pass through; those with the added names are replaced.  An empty table gives
    none.  A text's disclosing words are bounded by its distinct words."""
    p = p or Params()
    _store.shared_dir(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("base", "spans", "clean")]
    text = F.col("text").cast("string").alias("text")
    numbered = [F.col(c).alias(f"c{k}") for k, c in enumerate(own) if c != "text"]
    found = find_entities(docs.select(*numbered, text))
    more = _disclosed(docs.select(text), p)
    if more is None:
        marked = found.withColumn("spans", F.col("base"))
    else:
        few = _store.small(more, p.broadcast_rows)
        keyed = found.withColumns(dict(zip(("k1", "k2"), _keys(), strict=True)))
        if few is more:  # only texts that hold an entity are shuffled
            marked = keyed.where("size(base) > 0").join(more, ["k1", "k2"], "left").unionByName(keyed.where("size(base) = 0").withColumn("more", F.expr(NONE)))
        else:
            marked = keyed.join(few, ["k1", "k2"], "left")
        marked = marked.withColumn("spans", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "more"))))
    return marked.withColumn("clean", F.expr(_clean())).select(*[F.col("text" if c == "text" else f"c{k}").alias(c) for k, c in enumerate(own)], "base", "spans", "clean")


def _joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def pii_digest(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """The columns of the contract and no clean text, for each row of docs."""
    found = sanitise(docs.select(F.col("doc_id"), F.col("text").cast("string")), p)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind in PATTERNS], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
