"""Secret scans by a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean query over lower-case trigrams: an AND of clauses, a
clause an OR of alternatives, an alternative an AND of trigrams. Postings (trigram, document) are
made for the trigrams that any rule asks for; queries are answered on the postings, and only their
candidates are verified by the expression itself. A rule without mandatory trigrams scans all.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as K  # the parse tree of the standard library's own expressions
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, own_name, small

#: Documents up to so many are broadcast as candidates; more are joined by id.
MAX_CANDIDATES = 1_000_000
#: A run of characters of which more strings than this are possible is cut.
MOST_STRINGS = 48


@dataclass(frozen=True)
class Rule:
    """kind, expression, the group that must have at least `least` characters; base rules count in the digest."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = False


# The three base kinds, then well-known public token formats.
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", 0, 0),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{24,}", 0, 0),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
)


def _strings(op, arg) -> set[str] | None:
    """All strings of one parsed item, lower-case, or None if they are not few."""
    if op is K.LITERAL:
        return {chr(arg).lower()}
    if op is K.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is K.LITERAL:
                out.add(chr(value).lower())
            elif kind is K.RANGE and value[1] - value[0] < 4:
                out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
            else:
                return None
        return out
    if op is K.SUBPATTERN:
        return _sequence(arg[3])
    if op is K.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is K.MAX_REPEAT and arg[1] is not K.MAXREPEAT and arg[1] <= 5:
        one = _sequence(arg[2])
        out = {""} if one is not None and arg[0] == 0 else set()
        power = {""}
        for n in range(1, int(arg[1]) + 1):
            power = {a + b for a in power for b in one or ()}
            if one is None or len(power) > MOST_STRINGS:
                return None
            out |= power if n >= arg[0] else set()
        return out
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        more = _strings(op, arg)
        if more is None:
            return None
        out = {a + b for a in out for b in more}
        if len(out) > MOST_STRINGS:
            return None
    return out


def trigram_query(regex: str) -> list[list[list[str]]]:
    """Clauses, alternatives and trigrams that each match of the expression must have; empty if it has none."""
    clauses: list[list[list[str]]] = []

    def close(run: set[str]) -> None:
        if min(map(len, run)) >= 3:
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            least = [s for s in sets if not any(t < s for t in sets)]
            clauses.append(sorted(sorted(s) for s in least))

    def walk(items) -> None:
        run = {""}
        for op, arg in items:
            more = _strings(op, arg)
            longer = {a + b for a in run for b in more} if more is not None else None
            if longer is not None and len(longer) <= MOST_STRINGS:
                run = longer
                continue
            close(run)
            run = more if more is not None else {""}
            if more is None and op is K.SUBPATTERN:
                walk(arg[3])
            elif more is None and op is K.MAX_REPEAT and arg[0] > 0:
                walk(arg[2])
        close(run)

    walk(parser.parse(regex))
    return clauses


def _spans(text: Column, rule: Rule) -> Column:
    """Matches of a rule as structs (start, rank, end), in code points: pieces between matches and the matches themselves add up."""
    between = F.split(text, rule.regex, -1)
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else found
    rank = next(i for i, r in enumerate(RULES) if r.kind == rule.kind)
    steps = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("m"), group.alias("g"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _gate(rule: Rule) -> str:
    """An expression that finds each text with a match that counts; a repeat of one class may be lengthened, as its runs are maximal."""
    return rf"{rule.regex[:-1]}{{{rule.least},}}" if rule.regex in (r"[0-9a-f]+",) else rule.regex


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """Inverted index (tri, doc_id) over the trigrams that the rules ask for."""
    wanted = sorted({t for r in rules for clause in trigram_query(r.regex) for alt in clause for t in alt})
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in wanted]))
    return low.select("doc_id", F.explode(held).alias("tri"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, kinds): documents whose trigrams answer the query of each kind. Only rules with a query take part."""
    rows = [(r.kind, c, a, t, len(alt), len(clauses)) for r in rules if (clauses := trigram_query(r.regex)) for c, clause in enumerate(clauses) for a, alt in enumerate(clause) for t in alt]
    queries = docs.sparkSession.createDataFrame(rows, "kind string, clause int, alt int, tri string, n_tri int, n_clauses int")
    # The rules are constants, a few hundred rows at most.
    hits = postings(docs, rules).join(F.broadcast(queries), "tri").groupBy("doc_id", "kind", "clause", "alt", "n_tri", "n_clauses").agg(F.countDistinct("tri").alias("n"))
    met = hits.where("n = n_tri").groupBy("doc_id", "kind", "n_clauses").agg(F.countDistinct("clause").alias("n"))
    return met.where("n = n_clauses").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """All columns of docs, and `secrets`: array of (start, rank, end, kind), in order of start and rank.

    docs: doc_id, text. Offsets are code points, end exclusive. Null texts have no secrets; an empty table
    stays empty; rows that share a doc_id, null included, are each scanned for the kinds that any of them
    is a candidate for. Clashing names: a column `secrets` of docs is replaced.
    """
    indexed = {r.kind for r in rules if trigram_query(r.regex)}
    key, kinds = own_name(docs, "candidate"), own_name(docs, "kinds")
    cand = small(cut(candidates(docs, rules).select(F.col("doc_id").alias(key), F.col("kinds").alias(kinds)), "secret-candidates"), MAX_CANDIDATES)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.join(cand, docs["doc_id"].eqNullSafe(cand[key]), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    each = []
    for r in rules:
        go = F.array_contains(F.col(kinds), r.kind) if r.kind in indexed else text.rlike(_gate(r))
        each.append(F.when(F.coalesce(go, F.lit(False)), _spans(text, r)).otherwise(none))
    return rows.withColumn("secrets", F.array_sort(F.concat(*each))).drop(key, kinds)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
