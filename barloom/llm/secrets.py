"""Secret scans: a trigram inverted index picks the texts that a rule may match.

From each rule's regular expression a Boolean query over trigrams is derived
(an OR of ANDs). The postings of those trigrams are intersected to candidate
(document, rule) pairs; only candidates are verified with the regular
expression. Rules whose language has no mandatory trigram scan every text.

Main path: DataFrame functions only. ``trigram_query`` runs once per rule on
the driver.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import let, lower_ascii

try:  # the regular-expression parser moved below re in Python 3.11
    from re import _parser as _sre
except ImportError:  # pragma: no cover
    import sre_parse as _sre


@dataclass(frozen=True)
class SecretRule:
    """kind: label of the spans. pattern: Java and Python syntax alike.
    any_case: ASCII letters of ``pattern`` fit in either case. group, min_group:
    a match counts only if that group (0: the match) has so many characters."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    min_chars: int = 0


#: The base rules, in the order in which spans at one start are listed.
BASE_RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", any_case=True, group=2, min_chars=6),
    SecretRule("access", r"AKIA[A-Z0-9]+", min_chars=20),
    SecretRule("hex", r"[0-9a-f]+", min_chars=24),
)
#: What the method adds to them.
MORE_RULES = (
    # the whole block; without its last line, all lines of base64 that follow (possessive: no engine recurses over them)
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:\s*(?:Proc-Type|DEK-Info): [^\n]*){0,2}[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/=]{16,})*+)"),
    SecretRule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
MAX_ALTERNATIVES = 64
#: A class of so many single characters is spelled out in the trigram query.
MAX_LETTERS = 8
#: Matches that one fold gathers: folds copy what they have gathered, so long lists are folded in blocks.
BLOCK = 256
SPANS_TYPE = "array<struct<s:int,r:int,e:int,kind:string>>"


def _strings(tree) -> list[list[str | None]]:
    """The alternatives of a parsed expression, each a list of literal characters and None for a gap."""
    found: list[list[str | None]] = [[]]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts: list[list[str | None]] = [[chr(arg)]]
        elif name == "SUBPATTERN":
            parts = _strings(arg[3])
        elif name == "BRANCH":
            parts = [s for branch in arg[1] for s in _strings(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            once = _strings(body)
            if (low, high) == (0, 1):
                parts = [[], *once]
            elif low == high and low <= 4:
                parts = [list(itertools.chain(*x)) for x in itertools.product(once, repeat=low)] if len(once) ** low <= MAX_ALTERNATIVES else [[None]]
            elif low >= 1:
                parts = [[*s, None] for s in once]
            else:
                parts = [[None]]
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= MAX_LETTERS:
            parts = [[chr(a)] for _, a in arg]
        else:
            parts = [[None]]
        if len(found) * len(parts) > MAX_ALTERNATIVES:
            parts = [[None]]
        found = [a + b for a in found for b in parts]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of ANDs of lower-case trigrams that every match of ``pattern`` contains.

    Empty when some alternative has no mandatory trigram: then nothing can be
    concluded from an index and each text has to be scanned.
    """
    clauses = set()
    for chars in _strings(_sre.parse(pattern)):
        runs = "".join("\0" if c is None else c for c in chars).split("\0")
        grams = frozenset(r[i : i + 3].lower() for r in runs for i in range(len(r) - 2) if r[i : i + 3].isascii())
        if not grams:
            return []
        clauses.add(grams)
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def java_pattern(rule: SecretRule) -> str:
    return f"(?i){rule.pattern}" if rule.any_case else rule.pattern


def _spans(text: Column, rule: SecretRule, rank: int) -> Column:
    """Array of struct(s, r, e, kind): leftmost, non-overlapping matches in code points.

    The text between matches comes from ``split`` and the matches from
    ``regexp_extract_all``; running sums of both lengths give the positions.
    """
    pattern = F.lit(java_pattern(rule))
    empty = F.lit([]).cast(SPANS_TYPE)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, java_pattern(rule), -1)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g)) if rule.group else F.transform(hits, lambda g: F.length(g))
    zipped = F.arrays_zip(
        F.transform(F.slice(gaps, F.lit(1), F.size(hits)), lambda g: F.length(g)).alias("gap"),
        F.transform(hits, lambda h: F.length(h)).alias("hit"),
        sizes.alias("val"),
    )
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, z: Column) -> Column:
        s = acc["at"] + z["gap"]
        span = F.struct(s.alias("s"), F.lit(rank).alias("r"), (s + z["hit"]).alias("e"), F.lit(rule.kind).alias("kind"))
        return F.struct((s + z["hit"]).alias("at"), F.when(z["val"] >= rule.min_chars, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def moved(parts: Column) -> Column:
        """Blocks with positions of their own, each moved by the length of the blocks before it."""
        offsets = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x["at"]))
        shifted = lambda x, by: F.transform(x["out"], lambda z: F.struct((z["s"] + by).alias("s"), z["r"].alias("r"), (z["e"] + by).alias("e"), z["kind"].alias("kind")))
        return let(offsets, lambda at: F.flatten(F.transform(parts, lambda x, i: shifted(x, F.get(at, i)))))

    found = let(_blocks(zipped), lambda blocks: let(F.transform(blocks, lambda block: F.aggregate(block, start, step)), moved))
    return F.when(text.rlike(java_pattern(rule)), found).otherwise(empty)


def _blocks(items: Column) -> Column:
    """An array of arrays of BLOCK items each."""
    return let(items, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(x, at + 1, F.lit(BLOCK))))


def _filtering(rule: SecretRule) -> SecretRule:
    """The same rule with its least length inside the expression, where that cannot change a match.

    For a run of one character class (``[..]+``, after an optional literal) a
    too short maximal run never hides a longer one, so ``{n,}`` is the same.
    """
    m = re.fullmatch(r"(\w*)(\[[^\]^]*\])\+", rule.pattern)
    if m and not rule.group and rule.min_chars > len(m[1]) and not rule.any_case and all(re.fullmatch(m[2], c) for c in m[1]):
        return SecretRule(rule.kind, f"{m[1]}{m[2]}{{{rule.min_chars - len(m[1])},}}")
    return rule


def candidates(docs: DataFrame, rules: list[tuple[int, list[frozenset[str]]]], key: str, text: str) -> DataFrame:
    """(key, rule ranks) by intersecting the postings of the rules' trigrams."""
    spark = docs.sparkSession
    grams = sorted({g for _, q in rules for c in q for g in c})
    clauses = [(g, rank, k, len(c)) for rank, q in rules for k, c in enumerate(q) for g in c]
    wanted = spark.createDataFrame(clauses, "gram string, rule int, clause int, size int")
    low = F.lower(F.col(text))
    postings = (
        docs.select(F.col(key), let(low, lambda t: F.array_compact(F.array(*[F.when(t.contains(g), F.lit(g)) for g in grams]))).alias("grams"))
        .select(key, F.explode("grams").alias("gram"))
    )
    # the query table has a row for each trigram of each clause: a fixed size
    hit = postings.join(F.broadcast(wanted), "gram").groupBy(key, "rule", "clause").agg(F.count_distinct("gram").alias("n"), F.first("size").alias("size"))
    return hit.where("n = size").groupBy(key).agg(F.collect_set("rule").alias("rules"))


def scan_secrets(docs: DataFrame, rules=BASE_RULES + MORE_RULES, key: str = "doc_id", text: str = "text", out: str = "secret_spans") -> DataFrame:
    """Add ``out``: array of struct(s, r, e, kind), all spans by start, then by the rules' order.

    Positions are code points, the end exclusive. Null and empty texts have no
    spans (an empty array). Texts are scanned whole. Rows that repeat a key
    are each scanned by their own text: candidates by key are a superset.
    Rows with a null key are scanned by every rule. A column named like
    ``out`` is replaced. An empty table gives an empty result.
    """
    tight = [(rank, _filtering(rule)) for rank, rule in enumerate(rules)]
    queries = [(rank, trigram_query(rule.pattern)) for rank, rule in tight]
    indexed = [(rank, q) for rank, q in queries if q]
    docs = docs.drop(out, "__rules")
    found = candidates(docs, indexed, key, text).withColumnRenamed(key, "__key").withColumnRenamed("rules", "__rules")
    joined = docs.join(found, F.col(key) == F.col("__key"), "left").drop("__key")
    value = F.coalesce(F.col(text), F.lit(""))
    none = _spans(F.lit(""), rules[0], 0)
    parts = []
    for rank, rule in tight:
        here = _spans(value, rule, rank)
        if any(rank == r for r, _ in indexed):
            here = F.when(F.col(key).isNull() | F.coalesce(F.array_contains("__rules", rank), F.lit(False)), here).otherwise(none)
        parts.append(here)
    return joined.withColumn(out, F.array_sort(F.concat(*parts))).drop("__rules")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span (overlapping ones together) replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def block_step(acc: Column, block: Column) -> Column:
        """A block's spans are cut from its own stretch of the text."""
        base = acc["at"]
        end = F.greatest(base, F.array_max(F.transform(block, lambda z: z["e"])))
        stretch = F.substring(text, base + 1, end - base)

        def folded(part: Column) -> Column:
            inner = F.struct(base.alias("at"), F.array().cast("array<string>").alias("out"))

            def step(a: Column, z: Column) -> Column:
                fresh = z["s"] >= a["at"]
                piece = F.concat(F.substring(part, a["at"] - base + 1, z["s"] - a["at"]), F.lit(mark))
                return F.struct(F.greatest(a["at"], z["e"]).alias("at"), F.when(fresh, F.array_append(a["out"], piece)).otherwise(a["out"]).alias("out"))

            return F.array_join(F.aggregate(block, inner, step, lambda a: a["out"]), "")

        return F.struct(end.alias("at"), F.concat(acc["out"], let(stretch, folded)).alias("out"))

    done = F.aggregate(_blocks(spans), start, block_step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs).select("doc_id", "secret_spans")
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda x: x["r"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("secret_spans")).alias("spans"),
    )
