"""Rule-list regex filter (F2) and its join form.

A rule file holds one extended regular expression per line; blank lines and
lines starting with ``#`` are skipped.  A name matching *any* rule is
"filtered", the rest pass through; the first matching rule (file order) is the
one reported.  Rule lists are small configuration files (tens of lines), read
with a size bound, and evaluated as one per-row expression:
``coalesce(when(name rlike r1, 1), when(name rlike r2, 2), ...)`` stops at the
first hit, needs no join and no shuffle, and stays in generated code.

``tag_many_rules`` is for long lists: names meet only the rules whose required literal they may
contain, by a join on a trigram of it, so that the cost isn't rules x names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def parse_rules(lines) -> list[str]:
    """Blank and ``#`` lines skipped; the rest kept verbatim, in order."""
    out = [ln.rstrip("\n") for ln in lines]
    return [ln for ln in out if ln != "" and not ln.startswith("#")]


def read_rules(path: str) -> list[str]:
    with open(path, encoding="utf-8") as fh:
        return parse_rules(fh)


def first_matching_rule(name: Column, rules: list[str]) -> Column:
    """1-based index of the first rule whose pattern occurs in ``name``, else NULL."""
    if not rules:
        return F.lit(None).cast("int")
    return F.coalesce(*[F.when(name.rlike(r), F.lit(i + 1)) for i, r in enumerate(rules)])


def any_rule_matches(name: Column, rules: list[str]) -> Column:
    """One alternation, one regex pass per row."""
    if not rules:
        return F.lit(False)
    return name.rlike("|".join(f"(?:{r})" for r in rules))


def split_by_rules(df: DataFrame, column: str, rules: list[str]) -> tuple[DataFrame, DataFrame]:
    """(filtered, passed); a row without a name passes."""
    hit = F.coalesce(any_rule_matches(F.col(column), rules), F.lit(False))
    return df.filter(hit), df.filter(~hit)


def tag_rules(df: DataFrame, column: str, rules: list[str]) -> DataFrame:
    """Each row with ``rule_no`` and ``rule`` of its first matching rule (NULL if none)."""
    idx = first_matching_rule(F.col(column), rules)
    arr = F.array(*[F.lit(r) for r in rules]) if rules else F.array().cast("array<string>")
    return df.withColumn("rule_no", idx).withColumn(
        "rule", F.when(F.col("rule_no").isNotNull(), F.element_at(arr, F.col("rule_no"))))


# ---------------------------------------------------------------- long lists
GRAM = 3
_SPECIAL = set(".[]()*+?{}|^$")


def required_literal(rule: str) -> str:
    """The longest string that every match of an extended regular expression must contain; '' if none is
    sure. Only plain characters outside groups and classes count; a rule with an alternative at its top has none."""
    runs, now, k, depth = [], "", 0, 0
    while k < len(rule):
        c = rule[k]
        size = 1
        plain = None
        if c == "\\":
            size = 2
            nxt = rule[k + 1:k + 2]
            plain = nxt if nxt and not nxt.isalnum() else None
        elif c == "[":
            end = k + 1 + (rule[k + 1:k + 2] == "^")
            end = rule.find("]", end + 1)  # a bracket that comes first is a member
            if end < 0:
                return ""
            size = end + 1 - k
        elif c == "{":  # a repetition, not text
            end = rule.find("}", k)
            if end < 0:
                return ""
            size = end + 1 - k
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            return ""
        elif c not in _SPECIAL:
            plain = c
        after = rule[k + size:k + size + 1]
        if depth or plain is None:
            runs.append(now)
            now = ""
        elif after and after in "?*{":
            runs.append(now)
            now = ""
        elif after == "+":
            runs.append(now + plain)
            now = ""
        else:
            now += plain
        k += size
    return max([*runs, now], key=len)


def tag_many_rules(df: DataFrame, column: str, rules: list[str]) -> DataFrame:
    """J7 for long lists: ``rule_no`` and ``rule`` of the first matching rule, as ``tag_rules`` gives them.

    The distinct names' trigrams are counted; each rule is indexed by the rarest trigram of its required
    literal (one that no name has can't match), joined with the names that hold it, and only these
    run its regex. Rules without a literal of GRAM characters run on every distinct name. A name
    without a match, and a null one, has nulls.
    """
    spark = df.sparkSession
    listed = [(i, r, required_literal(r)) for i, r in enumerate(rules, 1)]
    always = [(i, r) for i, r, literal in listed if len(literal) < GRAM]
    table = spark.createDataFrame([x for x in listed if len(x[2]) >= GRAM], "rule_no int, rule string, literal string")
    names = df.select(F.col(column).alias("_name")).filter("_name is not null").distinct()

    def grams(text: str) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - GRAM + 1), lambda i: F.substring(F.col(text), i, GRAM)))

    spelled = names.filter(F.char_length("_name") >= GRAM).select("_name", F.explode(grams("_name")).alias("_gram"))
    counts = spelled.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    index = table.select("*", F.explode(grams("literal")).alias("_gram")).join(counts, "_gram", "left")
    index = index.groupBy("rule_no", "rule", "literal").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram")).alias("_g")).filter("_g._n > 0")
    met = spelled.join(index.select("rule_no", "rule", "literal", F.col("_g._gram").alias("_gram")), "_gram")
    met = met.filter(F.contains("_name", "literal")).filter(F.rlike("_name", F.col("rule")))
    first = met.groupBy("_name").agg(F.min("rule_no").alias("_met"))
    if always:
        rest = F.coalesce(*[F.when(F.col("_name").rlike(r), F.lit(i)) for i, r in always])
        first = names.withColumn("_any", rest).join(first, "_name", "left").select("_name", F.least("_met", "_any").alias("_met")).filter("_met is not null")
    texts = spark.createDataFrame(list(enumerate(rules, 1)), "rule_no int, rule string")
    found = first.join(texts, F.col("_met") == F.col("rule_no")).select("_name", "rule_no", "rule")
    return df.join(found, F.col(column) == F.col("_name"), "left").drop("_name")
