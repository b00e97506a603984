"""Secret scans: token-like candidates, and a random forest that removes the false positives.

Candidates are runs of token characters, well-known forms, and all that stands behind a secret's name. Their features are length, character classes and transitions between them,
dictionary coverage, path and neighbouring words. The forest is Spark ML's, trained on labelled findings and on examples of every form; its trees
become one SQL expression, so a text is scanned and judged in place, with DataFrame functions only and no shuffle. The forest decides every candidate.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.matches import CONTEXT, matches
from claimloom.sources.scratch import written

#: Labelled findings that the forest is fitted on, at most: those first by a hash of the row.
ROWS = 20_000
#: Values of each template that the forest is also fitted on; together they weigh as much as the findings.
EXAMPLES = 24
TREES, DEPTH, SEED = 25, 8, 7
#: Share of the trees that must vote for a secret.
LEAST_SCORE = 0.5

#: Names that secrets are assigned to, and what may follow them: a number or version, or a word that leaves it a secret.
NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth"
_SUFFIX = r"(?:[_-]?v?[0-9]{1,8}|[_-](?:key|value|string|prod|dev|stage|staging|test|live|main|old|new))?" * 2
ASSIGNED = rf"(?:{NAMES}){_SUFFIX}[\"']?\s*(?:[:=]|:=|=>)\s*[\"']?$"
ACCESS_KEY = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"
#: Forms that only secrets have: keys and tokens of providers, web tokens, private keys (to their end, or as far as their lines go).
_PRIVATE_KEY = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[^-]*+(?:-{1,4}(?!-)[^-]*+)*+-----END [A-Z0-9 ]{0,60}-----|(?:\s{1,2}[A-Za-z0-9+/=]{16,})*+)"
_KNOWN = (
    r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}+|github_pat_[A-Za-z0-9_]{20,}+|xox[abeoprs]-[A-Za-z0-9-]{10,}+|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}+"
    r"|sk-[A-Za-z0-9_-]{20,}+|AIza[A-Za-z0-9_-]{30,}+|glpat-[A-Za-z0-9_-]{20,}+|npm_[A-Za-z0-9]{30,}+|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}+|ya29\.[A-Za-z0-9_-]{20,}+"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}(?:\.[A-Za-z0-9_-]++)*+)"
)
#: Directly behind a secret's name and an assignment; the first looks are cheap and fail at most places.
_BEHIND = rf"(?<=[:=>\"'\s])(?<=[:=>]\s{{0,8}}[\"']?)(?<=(?i:{NAMES}){_SUFFIX}[\"']?\s{{0,8}}(?::=|=>|[:=])\s{{0,8}}[\"']?)"
_START = r"(?<![A-Za-z0-9+/_-])"
_GIVEN = r"(?::=|=>|[:=])"
#: A secret's name and an assignment with more blanks than looking behind can pass; it is cut off the match.
_FAR = rf"{_START}[A-Za-z0-9+/_-]*?(?i:{NAMES}){_SUFFIX}[\"']?(?:\s{{9,}}+{_GIVEN}\s*+|\s*+{_GIVEN}\s{{9,}}+)"
#: Private keys, all in quotes behind a secret's name, well-known forms, all up to a blank behind a secret's name (without closing marks), and
#: runs of at least 8 token characters with a digit in them or directly behind "=", with dotted parts of a size that words don't have.
_RUNS = (
    rf"{_START}(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{{16,}}\.[A-Za-z0-9_-]{{4,}}\.[A-Za-z0-9_-]{{16,}}+"
    rf"|{_START}(?:(?=[A-Za-z+/_-]*+[0-9])|(?<==))[A-Za-z0-9+/_-]{{8,}}+"
)
CANDIDATE = (
    rf"{_PRIVATE_KEY}|{_BEHIND}(?:(?<=\")[^\"\r\n]++(?=\")|(?<=')[^'\r\n]++(?='))|{_START}{_KNOWN}"
    rf"|{_FAR}(?:\"[^\"\r\n]++(?=\")|'[^'\r\n]++(?=')|[\"']?(?![\s\"'=>:])\S*[^\s\"',;.)\]}}>])|{_BEHIND}(?![\s\"'=>:])\S*[^\s\"',;.)\]}}>]"
    rf"|{_RUNS}"
)
#: Texts that hold none of these, in any case or as they are, have only runs, which are faster to look for.
PARTS = ["pass", "pwd", "secret", "token", "credential", "key", "auth"]
MARKS = (
    "-----BEGIN AKIA ASIA ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ xox sk_live_ rk_live_ sk_test_ rk_test_ sk- AIza glpat- npm_ SG. ya29. eyJ"
).split()
#: Words of made-up values; 123456 is one too, but not in a well-known form, where ids are numbers.
PLACEHOLDERS = r"example|sample|dummy|changeme|change_me|placeholder|your[_-]|xxxx|redacted"
#: Letters and digits mixed in a run that is longer than words and numbers: may be a secret without a name.
VARIED = r"^(?=.*[0-9])(?=.*[A-Za-z])(?=.*[A-Za-z0-9]{12})[\s\S]{16,}$"
#: Without quotes: short words of prose behind a blank, words of program texts, references and calls. They may stand behind a secret's name and be no secret.
PROSE = r"^[A-Za-z]{1,7}$"
ORDINARY = rf"^(?i:none|null|nil|true|false|undefined|str|string|{NAMES})$|^\$.*$|^<.*$|^\{{\{{.*$|^%.*%$|^[A-Za-z_][A-Za-z0-9_.]*[\(\[].*$"
#: Words that identifiers and file names are made of.
DICTIONARY = (
    "access account action address admin agent archive array asset backup base batch block board book build cache card class client "
    "cloud code column config content control count data database date debug default delete demo detail device document domain "
    "driver error event example export field file filter folder form format function group handler header home host image import "
    "index input install item job key label language layer length level library light line link list load local lock login "
    "mail main manager master memory menu message method mobile model module month name network node number object option order "
    "output package page param parent password path pattern phone picture platform player plugin point policy port post process "
    "product profile project public query queue record release report request response result role root route sample schema "
    "search secret section security select server service session setting shared source stage start state static status "
    "storage store stream string style submit system table target task template test text theme thread time title token total "
    "type update upload user value version video view widget window word work worker year"
).split()

#: Words beside values that identify or check something.
IDENTIFIERS = r"commit|revision|sha-?[0-9]{0,3}|md5|crc(?:32)?|checksum|digest|hash|etag|uuid|guid|id|ids|number|no|version|build|page|order|invoice|call|phone|see|file|path"

#: What the forest sees: a candidate's shape, its path, and its neighbouring words.
SHAPE = ["size", "digits", "upper", "changes", "distinct", "vowels", "coverage", "slashes", "hex"]
FEATURES = [*SHAPE, "test_path", "assigned", "name_near", "equals", "placeholder", "known", "varied", "ordinary", "quoted", "identifier"]


def _share(value: Column, other: str) -> Column:
    """The share of the characters that are not of ``other``."""
    return F.char_length(F.regexp_replace(value, other, "")) / F.char_length(value)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _features(m: Column, path: Column) -> Column:
    """The features of a candidate, in the order of FEATURES."""
    value, before, low = m["value"], F.lower(m["before"]), F.lower(m["value"])
    changes = F.size(F.split(value, r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])")) - 1
    known = value.rlike(f"^(?:{_KNOWN}|{_PRIVATE_KEY})$")
    near = F.concat_ws(" ", before, F.lower(m["after"]))
    return F.array(
        F.char_length(value).cast("double"),
        _share(value, "[^0-9]"),
        _share(value, "[^A-Z]"),
        changes / F.char_length(value),
        F.size(F.array_distinct(F.split(value, ""))) / F.least(F.char_length(value), F.lit(64)),
        _share(low, "[^aeiou]"),
        1 - F.char_length(F.regexp_replace(low, "|".join(DICTIONARY), "")) / F.char_length(value),
        _share(value, "[^/]"),
        _flag(value.rlike("^[0-9a-f-]+$|^[0-9A-F-]+$")),
        _flag(F.lower(path).rlike(r"test|spec|example|fixture|docs?\b")),
        _flag(before.rlike(ASSIGNED)),
        _flag(near.rlike(rf"(?<![a-z])(?:{NAMES})(?![a-z])")),
        _flag(before.rlike("[:=]\\s*[\"']?$")),
        _flag(F.concat_ws(" ", low, F.right(before, F.lit(12))).rlike(PLACEHOLDERS) | (low.contains("123456") & ~known)),
        _flag(known),
        _flag(value.rlike(VARIED)),
        _flag((value.rlike(ORDINARY) & ~before.rlike("[\"']$")) | (value.rlike(PROSE) & before.rlike(r"\s$"))),
        _flag(before.rlike("[\"']$") & m["after"].rlike("^[\"']")),
        _flag(before.rlike(rf"(?<![a-z])(?:{IDENTIFIERS})[\s:#=]*$") | m["after"].rlike(rf"^\s*(?:{IDENTIFIERS})(?![a-z])")),
    )


def _value_only(m: Column) -> Column:
    """A match without the name and the assignment far before its value: they become part of the text before, their blanks drawn together."""
    far = rf"^({_FAR}[\"']?)[\s\S]*$"
    lead = F.when(m["value"].rlike(far) & ~m["before"].rlike(ASSIGNED), F.regexp_extract(m["value"], far, 1)).otherwise("")
    size = F.char_length(lead)
    cut = m.withField("start", m["start"] + size).withField("value", F.substring(m["value"], size + 1, F.char_length(m["value"]) - size))
    return F.when(size > 0, cut.withField("before", F.right(F.concat(m["before"], F.regexp_replace(lead, r"\s+", " ")), F.lit(CONTEXT)))).otherwise(m)


def candidates(docs: DataFrame, text: str, path: str) -> DataFrame:
    """``docs`` with the array candidates: start, end (code points), value, before, after, f (the features)."""
    whole, where = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(path).cast("string"), F.lit(""))
    low = F.lower(whole)
    wide = reduce(Column.__or__, [low.contains(x) for x in PARTS] + [whole.contains(x) for x in MARKS])
    found = F.when(wide, F.transform(matches(whole, CANDIDATE, F.lit(True)), _value_only)).otherwise(matches(whole, _RUNS, whole.rlike("[0-9=]")))
    return docs.withColumn("candidates", F.transform(found, lambda m: m.withField("f", _features(m, where))))


def _settled(f: Column) -> Column:
    """1 or 0 where form and context settle whether a candidate is a secret, else null.

    Secrets: well-known forms, and what is assigned to a secret's name, but for placeholders and ordinary words. No secrets: placeholders, ordinary words, and what
    has no secret's name near it, no assignment and no variety. A varied token without a name may be either.
    """
    at = {name: f[i] == 1 for i, name in enumerate(FEATURES)}
    secret = (at["known"] | (at["assigned"] & ~at["ordinary"])) & ~at["placeholder"]
    other = at["placeholder"] | at["ordinary"] & ~at["known"] | ~(at["known"] | at["name_near"] | at["equals"] | at["varied"])
    return F.when(secret, 1.0).when(other, 0.0)


def labelled_by_format(found: DataFrame) -> DataFrame:
    """Findings (value, f, y) that are settled, where no human labels exist."""
    rows = found.select(F.explode("candidates").alias("c")).select("c.value", "c.f")
    return rows.select("value", "f", _settled(F.col("f")).alias("y")).where("y IS NOT NULL")


#: Templates of labelled examples: the text with a place for the value, the value's kind, and 1 for a secret.
TEMPLATES = [
    *[(t, k, 1.0) for k in ("mixed", "hex", "short", "symbols") for t in ('token = "{}" now', "password={} ok", "api_key: '{}'", 'export AUTH_TOKEN_2="{}"')],
    *[(t, "words", 1.0) for t in ("password: {} then", 'secret = "{}"', "pwd={}", "passphrase: {}")],
    *[(f"{t} {p}{{}} in it", "tail", 1.0) for t in ("the", "a header", "?key=") for p in ("ghp_", "AIza", "glpat-", "npm_", "sk-", "sk_live_", "github_pat_", "xoxb-12345678901-")],
    *[(t, "access", 1.0) for t in ("the {} was", "id {} of", 'key="{}"')],
    *[(t, "web", 1.0) for t in ("got {} there", 'Bearer {}', 'token = "{}"')],
    *[(t, "block", 1.0) for t in ("a {} b", "key: {}")],
    *[(t, "mixed", 1.0) for t in ("it was {} all along", "with {} in it", "leaked {} again", "then {}", "x={} y")],
    *[(t, k, 0.0) for k in ("hex", "digest", "md5") for t in ("commit {} fixes it", "sha256: {}", "md5 {} of", "the {} was", "checksum={}", "at {} then")],
    *[(t, "uuid", 0.0) for t in ("uuid {} is", "request {} ended", "id={} ok")],
    *[(t, "digits", 0.0) for t in ("call {} now", "number {} is", "order={} paid", "at {} then")],
    *[(t, "page", 0.0) for t in ("see {} and", "the {} of", "file={}", 'name = "{}"')],
    *[(t, "made_up", 0.0) for t in ('token = "{}"', "password={}", "api_key: {} here", "secret: '{}'")],
    *[(t, "ordinary", 0.0) for t in ("token = {}", "password: {} of", "secret = {} here", "auth: {} then")],
    *[(t, "prose", 0.0) for t in ("password: {} one", "secret: {} of", "the token: {} of")],
]


def _values(n: Column) -> dict[str, Column]:
    """The n-th value of each kind; values look random and are the same in every run."""
    digest = F.sha2(n.cast("string"), 512)
    tail = F.translate(F.base64(F.unhex(digest)), "+/=\r\n", "xYz")
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(n * k, F.lit(len(words))) + 1).cast("int"))
    word, other = pick(DICTIONARY, 7), pick(DICTIONARY, 31)
    part = lambda i, size: F.substring(digest, i, size)
    return {
        "mixed": F.substring(tail, 1, 40), "hex": F.substring(digest, 1, 40), "digest": F.substring(digest, 1, 64), "md5": F.substring(digest, 1, 32),
        "short": F.substring(tail, 1, 14), "symbols": F.concat(F.substring(tail, 1, 6), F.lit("!"), F.substring(tail, 7, 3), F.lit("&"), F.substring(tail, 10, 4)),
        "words": F.concat(word, F.lit("horse"), other), "tail": F.substring(tail, 1, 36), "access": F.concat(F.lit("AKIA"), F.upper(part(1, 16))),
        "web": F.concat(F.lit("eyJ"), F.substring(tail, 1, 20), F.lit(".eyJ"), F.substring(tail, 20, 16), F.lit("."), F.substring(tail, 40, 30)),
        "block": F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), F.substring(tail, 1, 64), F.lit("\n-----END PRIVATE KEY-----")),
        "uuid": F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)),
        "digits": F.substring(F.translate(digest, "abcdef", "135792"), 1, 13), "page": F.concat_ws("-", word, n.cast("string"), F.lit("of"), F.lit("1000")),
        "made_up": F.concat(pick(["example-", "changeme", "your-", "dummy_", "xxxx", "sample-", "redacted"], 1), pick(["", "key1", "token2", "value"], 3)),
        "ordinary": F.concat(pick(["read_", "get_", "None", "$", "true", "load_", "<", "null"], 1), pick(["token(1234)", "", "config[3]", "SECRET_1", "value2>", "", "key(12)", ""], 1)),
        "prose": pick(["the", "reset", "old", "first", "a", "lost", "shared", "same"], 1),
    }


def examples(spark: SparkSession) -> DataFrame:
    """Labelled findings (value, f, y) made from TEMPLATES, EXAMPLES of each: the forest knows forms and contexts that the labelled documents lack."""
    templates = F.array(*[F.struct(*map(F.lit, (*t.split("{}"), k, y))) for t, k, y in TEMPLATES])
    values = F.create_map(*[x for k, v in _values(F.col("id")).items() for x in (F.lit(k), v)])
    made = spark.range(EXAMPLES).select(values.alias("v"), F.explode(templates).alias("t")).select(F.col("t.*"), "v").toDF("left", "right", "kind", "y", "v")
    texts = written(made.select(F.concat("left", F.col("v")[F.col("kind")], "right").alias("text"), F.col("v")[F.col("kind")].alias("want"), "y"), "examples")
    found = candidates(texts.withColumn("path", F.lit("")), "text", "path").select("want", "y", F.explode("candidates").alias("c"))
    return found.where(F.endswith("c.value", "want")).select("c.value", "c.f", "y")


def forest(labelled: DataFrame, more: DataFrame | None = None):
    """Fit on labelled findings (value, f, y): at most ROWS of each label, and on all of ``more``, which weighs as much. None without findings of both labels."""
    labelled = written(labelled.select("value", "f", "y"), "labelled")
    parts = [labelled.where(F.col("y") == y).orderBy(F.xxhash64("value", "f"), "value").limit(ROWS) for y in (0.0, 1.0)]
    rows = reduce(DataFrame.unionByName, parts).withColumn("weight", F.lit(1.0))
    if more is not None:
        more = written(more.select("value", "f", "y"), "examples")
        rows = rows.unionByName(more.withColumn("weight", F.lit(max(1.0, rows.count() / max(1, more.count())))))
    rows = rows.select("y", "weight", *(F.col("f")[i].alias(n) for i, n in enumerate(FEATURES))).coalesce(1)
    if rows.select("y").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8, featureSubsetStrategy="0.4").fit(vectors)


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")
_LEAF = re.compile(r"^( *)Predict: (\S+)$")


def _tree(lines: list[str], f: Column) -> Column:
    """The vote of a tree, from its printed form (consumed line by line)."""
    line = lines.pop(0)
    if leaf := _LEAF.match(line):
        return F.lit(float(leaf[2]))
    _, _, feature, _, value = _SPLIT.match(line).groups()
    yes = _tree(lines, f)
    assert _SPLIT.match(lines.pop(0))[2] == "Else"
    return F.when(f[int(feature)] <= float(value), yes).otherwise(_tree(lines, f))


def vote(model, f: Column) -> Column:
    """The share of the trees that vote for a secret. Without a model: 1 where form and context settle it as a secret, else 0."""
    if model is None:
        return F.coalesce(_settled(f), F.lit(0.0))
    trees = re.split(r"^ *Tree \d+ .*\n", model.toDebugString, flags=re.M)[1:]
    votes = [_tree([x for x in t.splitlines() if x.strip()], f) for t in trees]
    return reduce(Column.__add__, votes) / len(votes)


def voted(found: DataFrame, model) -> DataFrame:
    """The array findings in place of the array candidates: start, end (code points, end exclusive), kind, score, secret. A column ``findings`` is replaced."""
    scored = F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), c["f"].alias("f"), vote(model, c["f"]).alias("score")))
    kind = lambda c: F.when(c["value"].rlike(ACCESS_KEY), "access_key").when(c["f"][FEATURES.index("known")] == 1, "known_form").when(c["f"][FEATURES.index("assigned")] == 1, "assigned").otherwise("token")
    final = F.transform(scored, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), kind(c).alias("kind"), c["score"].alias("score"), (c["score"] >= LEAST_SCORE).alias("secret")))
    return found.withColumn("findings", final).drop("candidates")


def judged(docs: DataFrame, text: str, path: str, model) -> DataFrame:
    """``docs`` with the array findings of ``voted``.

    A null or empty text has no findings; a null path is an empty one. A column ``findings`` or ``candidates`` in ``docs`` is replaced. Texts
    are taken whole, ties and repeated rows get the same answer, and an empty table stays empty.
    """
    return voted(candidates(docs.drop("findings", "candidates"), text, path), model)


def redacted(text: str, mark: str = "[SECRET]") -> Column:
    """The text with its secrets replaced; needs the findings."""
    cut = F.filter("findings", lambda x: x["secret"])
    ends = F.concat(F.array(F.lit(0)), F.transform(cut, lambda x: x["end"]))
    starts = F.concat(F.transform(cut, lambda x: x["start"]), F.array(F.char_length(text)))
    return F.when(F.size(cut) > 0, F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text), a + 1, b - a)), mark)).otherwise(F.col(text))
