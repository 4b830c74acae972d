"""Information-theoretic sanitisation over whole texts.

Patterns find the protected entities: e-mail addresses, IP addresses, card and phone numbers, and one level up what
several of them share: the domain, the network (three parts), the issuer (six digits), the number but for its last
four digits. Few mentions of each of many addresses so add up to evidence about their group. What a document
says elsewhere can reveal them as well. So terms (runs of letters and digits outside those spans) are counted in
documents: n of them in all, n_c name the entity, n_t hold the term, n_ct do both. The pointwise mutual
information log2(n n_ct / (n_c n_t)) tells how strongly the term reveals the entity; it is held against the
entity's own information log2(n / n_c). From ``generalise_from`` times of it on the term is generalised to its
class, from ``remove_from`` times on (each document with the term names the entity) it is removed, in every
document that has it. Copies of one passage are no evidence: a document counts as evidence by the ``WIDTH``
characters on either side of its mention, and a term needs ``least_contexts`` different ones.

What is counted shrinks step by step. Only documents with mentions are kept between the passes, and of those only
entities with enough different surroundings are counted with terms. A term's count among the documents with mentions
bounds its count in all of them from below, which leaves few terms to be counted in the whole corpus. Every
count adds up in each task before its shuffle, and the terms found meet the texts by a join, which is a broadcast
while there are few of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlight.llm.common import materialised

KINDS = ("email", "ip", "card", "phone")
#: The kinds' patterns. Quantifiers that need no way back are possessive, and runs are entered at their beginning
#: (or where the last match ended), so that long runs take linear time; the matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]++(?:['’-][\p{L}\p{N}]++)*+"
#: Characters on either side of a mention that are its surroundings; shortest term; most terms or texts that are broadcast.
WIDTH, LEAST_LETTERS, MOST_BROADCAST = 60, 4, 100_000
#: Characters a piece of a text that has spans.
PIECE = 4096
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: Classes that terms are generalised to, by what they look like; the first that matches.
CLASSES = {r"^\p{N}+$": "[NUMBER]", r"\p{N}": "[CODE]", r"^\p{Lu}": "[NAME]", "": "[TERM]"}


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(values: str, step: str) -> str:
    """SQL: the running sums (step ``x + y``) or maxima (``greatest(x, y)``) of an array of numbers from zero on, in n log n: round k adds what is 2^k places before."""
    shifted = "slice(concat(array_repeat(0, shiftleft(1, k)), a), 1, size(a))"
    return f"aggregate(sequence(0, cast(ceil(log2(greatest(size({values}), 1))) as int)), {values}, (a, k) -> zip_with(a, {shifted}, (x, y) -> {step}))"


def matches(text: str, values: str, pattern: str, wanted: str, at: str = "0") -> str:
    """SQL: array<struct<s, e, v>> of those matches m in a text for which ``wanted`` holds; code points, end exclusive.

    regexp_extract_all has given the ``values`` of all matches; the text begins at place ``at``. A match ends where
    the lengths of all matches and of the gaps before them add up to.
    """
    gaps = f"split({text}, {_text(pattern)}, -1)"
    ends = running(f"zip_with(slice({gaps}, 1, size({values})), {values}, (g, v) -> length(g) + length(v))", "x + y")
    return f"""case when size({values}) = 0 then cast(array() as array<struct<s:int,e:int,v:string>>) else
      filter(zip_with({ends}, {values}, (t, v) -> struct({at} + t - length(v) as s, {at} + t as e, v as v)), m -> {wanted}) end"""


def cut(at: str, size: str) -> str:
    """SQL: the ``size`` characters of __text from place ``at`` on, read from its __pieces and so without walking through the text."""
    first, last = f"cast(({at}) div {PIECE} as int)", f"cast((({at}) + greatest({size}, 1) - 1) div {PIECE} as int)"
    return f"substring(array_join(slice(__pieces, {first} + 1, {last} - {first} + 1), ''), ({at}) % {PIECE} + 1, {size})"


def _valid(kind: str) -> str:
    digits = "regexp_replace(m.v, '[^0-9]', '')"
    if kind == "ip":
        return "not exists(split(m.v, '[.]'), p -> length(ltrim('0', p)) > 3 or cast(right(concat('0', ltrim('0', p)), 4) as int) > 255)"
    if kind == "phone":
        return f"length({digits}) between 10 and 15"
    if kind == "card":
        # Luhn: from the right, every second digit is doubled, and the digits of the result are added.
        return f"""length({digits}) between 14 and 19 and aggregate(transform(sequence(1, least(length({digits}), 19)),
          i -> cast(substring(reverse({digits}), i, 1) as int) * (2 - i % 2)), 0, (s, d) -> s + if(d > 9, d - 9, d)) % 10 = 0"""
    return "true"


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds __text (null as empty), __base: array<struct<s, k, e, v>> of the base spans by start, then kind, and __pieces: the text in pieces (none without spans)."""
    prefilter = {"email": "instr(__text, '@') > 0", "ip": "instr(__text, '.') > 0", "card": "true", "phone": "instr(__text, '+') > 0"}
    found = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    found = found.select("*", *[F.expr(f"case when {prefilter[k]} then regexp_extract_all(__text, {_text(PATTERNS[k])}, 0) else cast(array() as array<string>) end").alias(f"__v_{k}") for k in KINDS])
    parts = [f"transform({matches('__text', f'__v_{k}', PATTERNS[k], _valid(k))}, m -> struct(m.s as s, {i} as k, m.e as e, m.v as v))" for i, k in enumerate(KINDS)]
    found = found.withColumn("__base", F.expr(f"array_sort(concat({', '.join(parts)}))")).drop(*[f"__v_{k}" for k in KINDS])
    return found.withColumn("__pieces", F.expr(f"case when size(__base) = 0 then cast(array() as array<string>) else regexp_extract_all(__text, '(?s).{{1,{PIECE}}}+', 0) end"))


def with_parts(found: DataFrame) -> DataFrame:
    """Adds __parts: array<struct<at, t, k>>, the text between the base spans, where it begins, and the kind of the span that follows (null at the end).

    A span that reaches beyond one that it overlaps follows an empty part, so no character of a span is in a part.
    """
    found = found.withColumn("__at", F.expr(f"concat(array(0), {running('transform(__base, x -> x.e)', 'greatest(x, y)')})"))
    last = "__at[size(__base)]"
    parts = f"""concat(
      transform(filter(zip_with(__base, slice(__at, 1, size(__base)), (x, a) -> struct(a as at, x.s as s, x.e as e, x.k as k)), x -> x.e > x.at),
        x -> struct(x.at as at, {cut('x.at', 'greatest(x.s - x.at, 0)')} as t, x.k as k)),
      array(struct({last} as at, {cut(last, f'length(__text) - {last}')} as t, cast(null as int) as k)))"""
    return found.withColumn("__parts", F.expr(f"case when size(__base) = 0 then array(struct(0 as at, __text as t, cast(null as int) as k)) else {parts} end")).drop("__at")


def terms() -> Column:
    """The distinct terms of __parts, in lower case."""
    found = f"regexp_extract_all(array_join(transform(__parts, p -> p.t), '\\n'), {_text(TERM)}, 0)"
    return F.expr(f"array_distinct(transform(filter({found}, v -> length(v) >= {LEAST_LETTERS}), v -> lower(v)))")


def joined(spans: str) -> str:
    """SQL: kind:start:end of sorted spans, comma-joined."""
    names = f"array({', '.join(_text(k) for k in (*KINDS, 'term'))})"
    return f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def _few(df: DataFrame) -> DataFrame:
    """A written table, marked for a broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def disclosures(docs: DataFrame, *, least_contexts: int = 3, generalise_from: float = 0.9) -> DataFrame:
    """(entity, t, n, n_c, n_t, n_ct, contexts, information, shared): the pairs whose mutual information reaches the threshold."""
    whole = with_parts(with_base(docs.select("text")))
    digits = "regexp_replace(b.v, '[^0-9]', '')"
    name = f"case when b.k < 2 then lower(b.v) else {digits} end"
    group = f"case b.k when 0 then concat('@', lower(substring_index(b.v, '@', -1))) when 1 then concat(substring_index(b.v, '.', 3), '.*') when 2 then concat(left({digits}, 6), '*') else concat(left({digits}, length({digits}) - 4), '*') end"
    kind = f"array({', '.join(_text(k + ':') for k in KINDS)})[b.k]"
    start = f"greatest(b.s - {WIDTH}, 0)"
    named = f"transform(__base, b -> struct(concat({kind}, {name}) as name, concat({kind}, {group}) as group, xxhash64({cut(start, f'b.e + {WIDTH} - {start}')}) as context))"
    small = whole.where(F.size("__base") > 0).select(terms().alias("terms"), F.expr(named).alias("named"))
    small = small.withColumn("m", F.expr("array_sort(flatten(transform(named, x -> array(struct(x.name as entity, x.context as context), struct(x.group as entity, x.context as context)))))"))
    # The first of an entity's mentions in a document, by the digest of its surroundings.
    first = F.expr("filter(m, (x, i) -> not get(m, i - 1).entity <=> x.entity)")
    small = materialised(small.select(F.monotonically_increasing_id().alias("row"), first.alias("mentions"), "terms"))
    mentions = small.select("row", F.inline("mentions"))
    own = mentions.groupBy("entity", "context").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_c"), F.count("*").alias("contexts"))
    own = materialised(own.where(F.col("contexts") >= least_contexts).select("entity", "n_c"))
    n = docs.count()
    held = small.select(F.explode("terms").alias("t"))
    together = mentions.join(_few(own), "entity").join(small.select("row", "terms"), "row").select("entity", "n_c", "context", F.explode("terms").alias("t")).groupBy("entity", "t", "n_c", "context").agg(F.count("*").alias("n"))
    together = together.groupBy("entity", "t", "n_c").agg(F.sum("n").alias("n_ct"), F.count("*").alias("contexts")).where(F.col("contexts") >= least_contexts)
    information = F.log2(F.lit(float(n)) / F.col("n_c"))
    shared = lambda n_t: F.log2(F.col("n_ct") * float(n) / (F.col("n_c") * F.col(n_t)))
    reaches = lambda n_t: shared(n_t) >= generalise_from * information - 1e-9
    at_least = held.groupBy("t").agg(F.count("*").alias("n_with_mentions"))
    together = materialised(together.join(at_least, "t").where(reaches("n_with_mentions")).drop("n_with_mentions"))
    wanted = materialised(together.select("t").distinct())
    everywhere = whole.select(F.explode(terms()).alias("t")) if not wanted.isEmpty() else held
    n_t = everywhere.join(_few(wanted), "t").groupBy("t").agg(F.count("*").alias("n_t"))
    found = together.join(n_t, "t").where(reaches("n_t"))
    return found.select("entity", "t", F.lit(n).cast("bigint").alias("n"), "n_c", "n_t", "n_ct", "contexts", information.alias("information"), shared("n_t").alias("shared"))


def with_risky_terms(docs: DataFrame, *, remove_from: float = 1.0, **how) -> DataFrame:
    """docs with __text, __base, __parts and __risky: the map of the text's terms to sanitise, and whether to remove them (null if there are none)."""
    whole = with_parts(with_base(docs))
    pairs = disclosures(docs, **how)
    risky = materialised(pairs.groupBy("t").agg(F.bool_or(F.col("shared") >= remove_from * F.col("information") - 1e-9).alias("remove")))
    if risky.isEmpty():
        return whole.withColumn("__risky", F.lit(None).cast("map<string,boolean>"))
    # Texts, not rows, meet their terms: two hashes name a text, and its copies share an entry.
    key = [F.xxhash64("__text").alias("__key"), F.xxhash64(F.lit(1), "__text").alias("__key2")]
    hits = whole.select(*key, F.explode(terms()).alias("t")).join(_few(risky), "t").distinct().groupBy("__key", "__key2").agg(F.map_from_entries(F.collect_list(F.struct("t", "remove"))).alias("__risky"))
    return whole.select("*", *key).join(_few(materialised(hits)), ["__key", "__key2"], "left").drop("__key", "__key2")


RISKY = f"length(m.v) >= {LEAST_LETTERS} and map_contains_key(__risky, lower(m.v))"


def find_spans(docs: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base spans and terms).

    Null and empty texts have no spans. Rows count by themselves, equal ones alike, and null ids stay null.
    """
    found = with_risky_terms(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), **how)
    values = f"regexp_extract_all(p.t, {_text(TERM)}, 0)"
    places = f"flatten(transform(__parts, p -> {matches('p.t', values, TERM, RISKY, 'p.at')}))"
    found = found.withColumn("__all", F.expr(f"""case when __risky is null then transform(__base, x -> struct(x.s as s, x.k as k, x.e as e)) else
      array_sort(concat(transform(__base, x -> struct(x.s as s, x.k as k, x.e as e)), transform({places}, x -> struct(x.s as s, {len(KINDS)} as k, x.e as e)))) end"""))
    counts = [F.expr(f"cast(size(filter(__base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined("__base")), 256).alias("base_sha256"), F.expr(joined("__all")).alias("spans"))


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """docs with each base span replaced by its kind's label, revealing terms by their class or, where they name the entity, by nothing.

    Of overlapping spans each that reaches beyond the one before it leaves a label. Null texts stay null; all columns and rows stay.
    """
    found = with_risky_terms(docs, **how)
    label = f"case when p.k is null then '' else array({', '.join(_text(LABELS[k]) for k in KINDS)})[p.k] end"
    general = f"case {' '.join(f'when m.v rlike {_text(pattern)} then {_text(name)}' for pattern, name in CLASSES.items())} end"
    value = f"case when not ({RISKY}) then m.v when __risky[lower(m.v)] then '' else {general} end"
    values = f"transform(transform(regexp_extract_all(p.t, {_text(TERM)}, 0), v -> struct(v as v)), m -> {value})"
    clean = f"case when __risky is null then p.t else array_join(zip_with(split(p.t, {_text(TERM)}, -1), concat({values}, array('')), (g, v) -> concat(g, v)), '') end"
    text = F.expr(f"case when size(__base) = 0 and __risky is null then text else array_join(transform(__parts, p -> concat({clean}, {label})), '') end")
    return found.withColumn("text", text).select(*docs.columns)
