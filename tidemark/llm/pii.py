"""Personal data: patterns for four kinds, and bootstrapped contextual extraction. DataFrame and SQL functions only.

Instances are tokens with a digit or an ``@``, together with the groups of digits that follow them. The two words before, the two after, the one on either side and
the key in ``key=value`` are their lexical patterns. Entities that the base patterns find are the seeds. In every round a pattern's score for a kind is the mean confidence, for that kind, of its
distinct instances; an instance's confidence is the noisy-or of the scores of its patterns. Patterns that
SUPPORT or more distinct instances of confidence CONFIDENCE or more back, seeds or found in an earlier round, and that score CONFIDENCE or more discover the identifiers that the base patterns miss;
what they discover backs further patterns in the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

KINDS = ("email", "ip", "card", "phone")
#: The kinds' patterns, written so that a failing start costs no more than a step: a match starts where a run of its first
#: characters starts or the match before has ended, and runs that nothing may shorten are possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDED = {"email": "contains(text, '@')", "ip": r"text rlike '[0-9]\\.[0-9]'", "card": r"text rlike '[0-9][\\x20-]?[0-9]'", "phone": r"text rlike '\\+[0-9]'"}
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": r"forall(split(m, '\\.'), x -> length(ltrim('0', x)) <= 3 and cast(concat('0', right(x, 3)) as int) <= 255)",
    "card": f"length({_DIGITS}) between 13 and 19 and aggregate(transform(split(reverse({_DIGITS}), ''), (x, i) -> case when i % 2 = 0 then cast(x as int) else cast((2 * cast(x as int)) div 10 as int) + (2 * cast(x as int)) % 10 end), 0, (a, x) -> a + x) % 10 = 0",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[0-9()+.-]*+(?<=[0-9()+.-])(?=\s|$|[,;:!?]))*+"
#: Matches whose array is copied at once while the positions are added up.
RUN = 256
#: Discovered spans that may be broadcast.
FEW = 200_000
CONFIDENCE, SUPPORT, ROUNDS = 0.8, 5, 3
_SPANS = "array<struct<s:int,e:int,m:string>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(pattern: str, more: dict[str, tuple[str, str]] | None = None) -> str:
    """SQL: array of (s, e, m) of the matches of ``pattern`` in ``text``, in code points; ``more`` are further fields (type, SQL over x.m, the match,
    x.b and x.n, the text from the match before and to the next).

    Matches are added up in runs of RUN, so that the copies of the growing array stay few."""
    p = _quoted(pattern)
    more = more or {}
    fields = "".join(f",{name}:{kind}" for name, (kind, _) in more.items())
    own = "".join(f", {sql} as {name}" for name, (_, sql) in more.items())
    none = f"cast(array() as array<struct<s:int,e:int,m:string{fields}>>)"
    start, end = "i.at + length(x.b)", "i.at + length(x.b) + length(x.m)"
    return f"""
    aggregate(array(struct(split(text, {p}, -1) as b, regexp_extract_all(text, {p}, 0) as m)), {none}, (none, t) ->
      aggregate(array(transform(t.m, (m, k) -> struct(t.b[k] as b, m as m, t.b[k + 1] as n))), none, (nothing, z) ->
        if(size(z) = 0, none, aggregate(sequence(0, (size(z) - 1) div {RUN}), struct(0 as at, none as got), (a, c) ->
          aggregate(slice(z, cast(c * {RUN} + 1 as int), {RUN}), struct(a.at as at, none as got),
            (i, x) -> struct({end} as at, concat(i.got, array(struct({start} as s, {end} as e, x.m as m{own}))) as got),
            i -> struct(i.at as at, concat(a.got, i.got) as got)),
          a -> a.got))))"""


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, email, ip, card, phone): the valid base matches of every row as arrays of (s, e, m)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    for kind in KINDS:
        own = f"transform(filter({located(PATTERNS[kind])}, x -> {VALID[kind].replace('(m,', '(x.m,')}), x -> struct(x.s as s, x.e as e, x.m as m))"
        rows = rows.withColumn(kind, F.expr(f"case when {NEEDED[kind]} then {own} else cast(array() as {_SPANS}) end"))
    return rows


def _candidates(rows: DataFrame) -> DataFrame:
    """Adds ``cand``: the instances as (s, e, core, kind, patterns); kind is that of the base span they meet, or null."""
    kind = "case " + " ".join(f"when exists({k}, y -> y.s < x.e and y.e > x.s) then '{k}'" for k in KINDS) + " end"
    lead = r"length(regexp_extract(x.m, '^[^0-9A-Za-z+(]*+', 0))"
    core = r"regexp_extract(x.m, '^[^0-9A-Za-z+(]*+(.*?)[^0-9A-Za-z]*$', 1)"
    word = lambda column, pattern: f"lower(regexp_replace(regexp_extract({column}, {_quoted(pattern)}, 1), {_quoted(r"\s+")}, ' '))"
    context = {
        "left": ("string", word("x.b", r"(?<!\S)(\S++\s++\S++)\s++$")),
        "right": ("string", word("x.n", r"^\s++(\S++\s++\S++)")),
        "beside": ("string", word("x.b", r"(?<!\S)(\S++)\s++$")),
        "behind": ("string", word("x.n", r"^\s++(\S++)")),
    }
    key = r"lower(regexp_extract(x.m, '^([^0-9@=:]{2,40}[=:])', 1))"
    named = [("before", "x.left", "x.left = ''"), ("after", "x.right", "x.right = ''"), ("around", "concat(x.beside, ' _ ', x.behind)", "x.beside = '' or x.behind = ''"), ("key", key, f"{key} = ''")]
    patterns = ", ".join(f"if({empty}, null, concat('{name} ', {sql}))" for name, sql, empty in named)
    out = f"""transform({located(TOKEN, context)}, x -> struct(x.s + {lead} as s, x.s + {lead} + length({core}) as e, {core} as core, {kind} as kind,
      filter(array({patterns}), z -> z is not null) as patterns))"""
    none = "cast(array() as array<struct<s:int,e:int,core:string,kind:string,patterns:array<string>>>)"
    return rows.withColumn("cand", F.expr(f"case when text rlike '[0-9@]' then {out} else {none} end"))


def bootstrap(found: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, score) of the trusted patterns. ``found`` (core, kind, pattern): occurrences; kind is null if unknown."""
    edges = cut(found.groupBy("pattern", "core").agg(F.max("kind").alias("kind")), "edges")
    total = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    seeds = edges.where("kind is not null").select("core", "kind").distinct().withColumn("c", F.lit(1.0))
    sure, scored = seeds, None
    for _ in range(rounds):
        # sums over instances are grouped before they meet the number of instances
        weight = edges.drop("kind").join(sure, "core").groupBy("pattern", "kind").agg(F.sum("c").alias("w"), F.count_if(F.col("c") >= confidence).alias("backing")).where(F.col("backing") >= support)
        last, scored = scored, cut(weight.join(total, "pattern").select("pattern", "kind", (F.col("w") / F.col("total")).alias("score")).where(F.col("score") >= confidence), "scored")
        more = edges.where("kind is null").select("core", "pattern").join(scored, "pattern").groupBy("core", "kind").agg((1 - F.exp(F.sum(F.log(1.0000001 - F.col("score"))))).alias("c"))
        sure = cut(seeds.union(more.join(seeds.select("core").distinct(), "core", "left_anti")), "sure")
        if last is not None and last.count() == scored.count():
            break  # nothing new is trusted
    return scored.groupBy("pattern").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("x")).select("pattern", "x.kind", "x.score")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(id, email, ip, card, phone, more): every row's base spans (s, e, m), and the spans (kind, s, e) that contexts discover.

    A null text is empty and has no spans, nor has a text without digits and without ``@``. A discovered span overlaps no base span.
    Equal texts get equal spans; repeated rows and null ids keep rows of their own. Columns of other names are ignored; an
    empty table gives an empty one."""
    rows = _candidates(base_spans(docs, id_col, text_col))
    text = ["key", "again"]  # two hashes stand for a text
    scan = cut(rows.select("id", F.xxhash64("text").alias("key"), F.xxhash64(F.lit(7), "text").alias("again"), *KINDS, "cand"), "scan")
    occur = scan.where("size(cand) > 0").select(*text, F.explode("cand").alias("c")).select(*text, "c.s", "c.e", "c.core", "c.kind", F.explode("c.patterns").alias("pattern")).where("core <> ''")
    trusted = bootstrap(occur, rounds, confidence, support)
    new = cut(occur.where("kind is null").drop("kind").join(trusted, "pattern").groupBy(*text, "s", "e").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")), "new")
    more = new.groupBy(*text).agg(F.sort_array(F.collect_set(F.struct("kind", "s", "e"))).alias("more"))
    none = F.expr("cast(array() as array<struct<kind:string,s:int,e:int>>)")
    few = new.limit(FEW + 1).count() <= FEW
    return scan.join(F.broadcast(more) if few else more, text, "left").select("id", *KINDS, F.coalesce("more", none).alias("more"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts and the base spans' hash, and all spans as text."""
    base = "concat(" + ", ".join(f"transform({k}, x -> concat('{k}:', x.s, ':', x.e))" for k in KINDS) + ")"
    extra = "concat(" + ", ".join(f"transform(filter(more, x -> x.kind = '{k}'), x -> concat('ctx_{k}:', x.s, ':', x.e))" for k in KINDS) + ")"
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(f"array_join({base}, ',')"), 256).alias("base_sha256"),
        F.expr(f"array_join(concat({base}, {extra}), ',')").alias("spans"),
        (sum((F.size(k) for k in KINDS), F.lit(0)) + F.size("more")).cast("long").alias("n_spans"),
    )
