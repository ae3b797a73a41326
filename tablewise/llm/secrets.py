"""Secret scans: a random forest removes the false positives among candidate strings.

Candidates are runs of 16 or more characters of keys and hashes, and shorter ones from 4 characters on
that are assigned to a cue (a password, token or key). Each gets features: length, changes between kinds
of characters, how much of it dictionary words cover, how varied it is, whether it has the shape of a
well-known key, its path, and the text before and behind it, other candidates included. A random forest,
trained from labelled findings, says which ones are secrets; words and names are candidates like others.

Main path: DataFrame and SQL functions only. A text is split once at its candidates, features are a
``transform`` over them, and the forest is written out as arrays that an ``aggregate`` walks, so scoring
and redaction happen within the row: no explode, join or shuffle, whatever a document holds.

The given tables label no findings; ``labelled_findings`` makes them by rule from well-known shapes
of secrets and of look-alikes (commits, checksums, card numbers, placeholders, identifiers). Own
findings with the same columns can be passed instead.

Null and empty texts have no candidates and stay as they are. Repeated rows are treated alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.shared import stored

# fixed values: shape of a candidate, and words that tell what it is
WORDS = (
    "access account admin api app auth bucket change client code commit config credential data default demo "
    "dummy example file fixture foo bar here image insert item key local login master module name none node "
    "null number object package pass password path placeholder private prod public replace sample secret "
    "server service session source string sync test token update url user value version your "
    # prose
    "about after also been before but can could from have into more must not only other over same some such than that "
    "the their them then there these they this through under until were what when where which while who will with would "
    "aber als auch aus bei dass dem den der des die durch ein eine einen einer für hat ich ihre ist kann mehr mit nach nicht "
    "noch nur oder sein sich sie sind und vom von vor war wenn werden wie wird wurde zum zur über "
    "avec ces cette comme dans des dont elle est être fait ils les leur mais même nous par pas plus pour que qui sans "
    "ses son sont sur tous très une vous "
    "como con cuando del donde ella ellos entre era esta este están hasta las los muy más ningún otra para pero porque "
    "ser sin sobre son sus también tiene todo una"
).split()
CUES = "secret|token|passw(or)?d|pwd|api[_-]?key|apikey|auth|credential|bearer|private[_-]?key|access[_-]?key"
ASSIGNED = "(?<![A-Za-z0-9])(?=[A-Za-z0-9])(?<=[=:>][^A-Za-z0-9]{0,8})(?<=(?i:%s)[A-Za-z0-9_]{0,12}[^A-Za-z0-9]{1,14})" % CUES
VALUE = ASSIGNED + "[A-Za-z0-9+/_!@#$%^&*~-]{4,}+={0,2}|[A-Za-z0-9+/_-]{16,}+={0,2}"
KEYS = "(AKIA|ASIA)[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}"
OTHERS = "commit|sha[0-9]*|md5|checksum|digest|hash|uuid|guid|version|revision|card|phone|order|invoice|isbn|etag"
QUIET_PATHS = "(^|[/._-])(tests?|fixtures?|examples?|samples?|docs?|vendor|locks?)([/._-]|$)"
FEATURES = ("size", "changes", "digits", "covered", "varied", "quiet_path", "cue", "other", "assigned", "hex", "known", "set", "code")
BEFORE, BEHIND = 40, 16  # characters of context


def _candidates(path: str) -> str:
    """SQL for the array of (value, before, behind, path); needs arrays ``__values`` and ``__pieces``."""
    # five candidates and what lies between them are longer than the context
    back = [f"substring(get(__pieces, i - {k}), -{BEFORE}, {BEFORE}), get(__values, i - {k})" for k in range(5, 0, -1)]
    before = f"array_join(array({', '.join(back)}, substring(get(__pieces, i), -{BEFORE}, {BEFORE})), '')"
    return f"""transform(__values, (v, i) -> struct(v AS value, substring({before}, -{BEFORE}, {BEFORE}) AS before,
        left(concat(left(get(__pieces, i + 1), {BEHIND}), coalesce(get(__values, i + 1), '')), {BEHIND}) AS behind,
        {path} AS path))"""


def _features(c: str) -> str:
    """SQL struct of the features of candidate ``c``."""
    words = "|".join(sorted(WORDS, key=lambda w: (-len(w), w)))
    n = f"length({c}.value)"
    return f"""named_struct(
        'value', {c}.value,
        'size', double(least({n}, 200)),
        'changes', regexp_count({c}.value,
            '(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]|[+/_=-]') / {n},
        'digits', length(regexp_replace({c}.value, '[^0-9]', '')) / {n},
        'covered', 1 - length(regexp_replace(lower({c}.value), '{words}', '')) / {n},
        'varied', size(array_distinct(split({c}.value, ''))) / least({n}, 64),
        'quiet_path', double(coalesce(lower({c}.path) RLIKE '{QUIET_PATHS}', false)),
        'cue', double(lower({c}.before) RLIKE '({CUES})[a-z0-9_]{{0,12}}[^A-Za-z0-9]{{0,14}}$'),
        'other', double(lower({c}.before) RLIKE '({OTHERS})[^A-Za-z0-9]{{0,14}}$'
            OR lower({c}.behind) RLIKE '^[^A-Za-z0-9]{{0,4}}({OTHERS})'),
        'assigned', double({c}.before RLIKE '[=:>][^A-Za-z0-9]{{0,8}}$'),
        'hex', double({c}.value RLIKE '^([0-9a-f]+|[0-9A-F]+)$' AND {c}.value RLIKE '[A-Fa-f]'),
        'known', double({c}.value RLIKE '^({KEYS})$'),
        'set', double({c}.before RLIKE '=[^A-Za-z0-9]{{0,8}}$|["`\\']$'),
        'code', double({c}.behind RLIKE '^([(]|\\\\[|://|[.][A-Za-z_])'))"""


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """``text``, ``path`` and ``label`` of made findings: known shapes by rule from a row number."""
    hexed, based = "sha1(string(id))", "substring(base64(unhex(sha2(string(id), 256))), 1, 40)"
    digits = "lpad(string(pmod(xxhash64(id), 10000000000000000L)), 16, '7')"
    cue = "element_at(array('token','secret','password','api_key','API_KEY','auth_token','client_secret','TOKEN','access_key'), int(pmod(xxhash64(id, 1), 9)) + 1)"
    sep = "element_at(array(' = \"','=','=\"',': ',': \"',' = ''','### =*** \"',' => \"'), int(pmod(xxhash64(id, 2), 8)) + 1)"
    word = "element_at(array('the','and','der','que','of','was','la','with','ran'), int(pmod(xxhash64(id, 3), 9)) + 1)"
    holder = "element_at(array('your_api_key_here_','example_token_value','changeme_password_','insert_secret_here_','test_user_password_'), int(pmod(xxhash64(id, 4), 5)) + 1)"
    letters = "translate(sha1(string(id)), '0123456789', 'ghijklmnop')"
    part = "element_at(array('keit','ung','lich','schaft','ber','ation','ment','inter','ver','cion','able','tamente'), int(pmod(xxhash64(id, k), 12)) + 1)"
    long = f"concat_ws('', transform(sequence(10, 14 + int(pmod(id, 3))), k -> {part}))"
    short = "element_at(array('None','null','string','true','false','required','that','invalid','missing','their','from','will'), int(pmod(xxhash64(id, 6), 12)) + 1)"
    name = "element_at(array('AWS_SECRET_ACCESS_KEY','SERVICE_ACCOUNT_PASSWORD','DATABASE_PASSWORD','GITHUB_ACCESS_TOKEN','client_secret_token','private_api_key_value'), int(pmod(xxhash64(id, 7), 6)) + 1)"
    put = "element_at(array(' = \"','=','=\"',' = \\'',': \"'), int(pmod(xxhash64(id, 8), 5)) + 1)"
    based32 = "substring(translate(upper(sha1(string(id))), '01234567', 'GHIJKLMN'), 1, 16)"
    path = "element_at(array('src/app/main.py','conf/prod.env','README.md','tests/fixtures/a.json','docs/guide.md','src7',NULL), int(pmod(xxhash64(id, 5), 7)) + 1)"
    shapes = [
        (1, f"concat({word}, ' ', {cue}, {sep}, {hexed}, '\" ', {word})"),
        (1, f"concat({word}, ' ', {cue}, {sep}, upper({hexed}), '\"!! ', {word})"),
        (1, f"concat({word}, ' ', {cue}, {sep}, md5(string(id)), ' ', {word})"),
        (1, f"concat({word}, ' ', {cue}, {sep}, {based}, ' ', {word})"),
        (1, f"concat('Authorization: Bearer ', {based}, ' ', {word})"),
        (1, f"concat({word}, ' ghp_', substring(translate({based}, '+/=', 'abc'), 1, 36), ' ', {word})"),
        (0, f"concat({word}, ' ', {digits}, ' ', {word})"),
        (0, f"concat({word}, ' ', {cue}, {sep}, {digits}, ' ', {word})"),
        (0, f"concat('commit ', {hexed}, ' ', {word})"),
        (0, f"concat('checksum: ', md5(string(id)), ' ', {word})"),
        (0, f"concat({word}, ' ', {hexed}, ' ', {word})"),
        (0, f"concat({word}, ' ', {cue}, {sep}, {holder}, pmod(id, 1000), '\" ', {word})"),
        (0, f"concat('version=', 'release-2024-', pmod(id, 12), '-build-', pmod(id, 977), ' ', {word})"),
        (0, f"concat('uuid ', substring({hexed}, 1, 8), '-', substring({hexed}, 9, 4), '-4', substring({hexed}, 13, 3), '-a', substring({hexed}, 16, 3), '-', substring({hexed}, 19, 12))"),
        (0, f"concat({word}, ' src/module', pmod(id, 50), '/service_client_', pmod(id, 9), ' ', {word})"),
        (1, f"concat({word}, ' ', {cue}, {put}, left({letters}, 16 + pmod(id, 15)), '\" ', {word})"),
        (1, f"concat({word}, ' ', {name}, {put}, {hexed}, '\" ', {word})"),
        (1, f"concat({word}, ' ', {name}, {put}, {based}, '\" ', {word})"),
        (1, f"concat({word}, ' ', {cue}, {put}, left({letters}, 6 + pmod(id, 10)), '\" ', {word})"),
        (1, f"concat({word}, ' ', {cue}, {put}, left({based}, 6 + pmod(id, 10)), '\" ', {word})"),
        (1, f"concat({word}, ' ', {cue}, ': ', left({letters}, 5), pmod(id, 977), '! ', {word})"),
        (1, f"concat({word}, ' AKIA', {based32}, ' ', {word})"),
        (1, f"concat({word}, ' ', {put}, 'AKIA', translate({based32}, '89', 'OP'), '\" ', {word})"),
        (0, f"concat({word}, ' ', {long}, ' ', {word})"),
        (0, f"concat({word}, ' ', initcap({long}), '-', {long}, ', ', {word})"),
        (0, f"concat({word}, ' ', upper({long}), ' ', {word})"),
        (0, f"concat({word}, {put}, {long}, '\" ', {word})"),
        (0, f"concat({word}, ' ', {cue}, ' ', {long}, ' ', {word})"),
        (0, f"concat({word}, ' ', {cue}, {put}, {name}, '\" ', {word})"),
        (0, f"concat({word}, ' ', {cue}, ': ', {short}, ' ', {word})"),
        (0, f"concat({word}, ' ', {cue}, ' = ', {name}, '(', {word}, ')')"),
        (0, f"concat({word}, ' ', {cue}, ' = ', left({letters}, 4 + pmod(id, 8)), '.', {word}, '(')"),
        (0, f"concat({word}, ' ', {cue}, {sep}, 'https://', {word}, '.org ')"),
        (0, f"concat({word}, ' ', {cue}, ' = ', element_at(array('None','null','true','example','changeme'), int(pmod(id, 5)) + 1), ' ', {word})"),
    ]
    case = " ".join(f"WHEN {k} THEN {text}" for k, (_, text) in enumerate(shapes))
    label = ", ".join(str(y) for y, _ in shapes)
    kind = f"int(pmod(id, {len(shapes)}))"
    return spark.range(0, rows, 1, 4).selectExpr(
        f"CASE {kind} {case} END AS text", f"{path} AS path", f"element_at(array({label}), {kind} + 1) AS label"
    )


def _with_features(df: DataFrame, text: str, path: str | None) -> DataFrame:
    """Arrays ``__pieces`` between and ``__values`` of the candidates, and their ``__features``."""
    has = f"`{text}` RLIKE '{VALUE}'"
    split = df.selectExpr(
        "*",
        f"CASE WHEN {has} THEN regexp_extract_all(`{text}`, '{VALUE}', 0) ELSE array() END AS __values",
        f"CASE WHEN {has} THEN split(`{text}`, '{VALUE}', -1) ELSE array() END AS __pieces",
    )
    named = f"CAST(`{path}` AS STRING)" if path else "CAST(NULL AS STRING)"
    made = split.selectExpr("*", f"{_candidates(named)} AS __candidates")
    return made.selectExpr("*", f"transform(__candidates, c -> {_features('c')}) AS __features").drop("__candidates")


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays, joined by commas: the feature a node asks for (from 1, 0 in a leaf), its
    threshold, its left child (the right one is next to it) and the share of secrets in a leaf."""

    roots: str
    depth: int
    feature: str
    threshold: str
    child: str
    value: str

    def score(self) -> str:
        """SQL over the array ``f`` of features: the mean share of the leaves that it ends in."""

        def listed(numbers: str, kind: str) -> str:
            return f"CAST(split('{numbers}', ',') AS ARRAY<{kind}>)"  # folded to one literal

        feature, threshold = listed(self.feature, "INT"), listed(self.threshold, "DOUBLE")
        child, value = listed(self.child, "INT"), listed(self.value, "DOUBLE")
        right = f"int(element_at(f, element_at({feature}, node)) > element_at({threshold}, node))"
        step = f"IF(element_at({feature}, node) = 0, node, element_at({child}, node) + {right})"
        leaf = f"aggregate(sequence(0, {self.depth}), root, (node, at) -> {step})"
        roots = listed(self.roots, "INT")
        return f"aggregate({roots}, 0D, (sum, root) -> sum + element_at({value}, {leaf})) / size({roots})"


def _constant(share: float) -> Forest:
    return Forest("1", 0, "0", "0", "0", repr(share))


def feature_rows(findings: DataFrame) -> DataFrame:
    """``label`` and features of every candidate in the findings, stored."""
    # the findings are an expression of many cases: stored, or it would be copied into every feature
    made = _with_features(stored(findings.select("text", "path", "label"), "findings"), "text", "path")
    rows = made.selectExpr("label", "posexplode(__features) AS (at, c)", "size(__features) AS n")
    # a name that a value is assigned to is no secret, whatever the value is
    label = "CASE WHEN at < n - 1 THEN 0.0D ELSE double(label) END"
    return stored(rows.where("label IS NOT NULL").selectExpr(f"{label} AS label", *[f"c.{x}" for x in FEATURES]), "features")


def train(findings: DataFrame, trees: int = 15, depth: int = 8, seed: int = 3) -> Forest:
    """A forest fitted to the findings. Without findings nothing is a secret; with one label all
    candidates get that label."""
    rows = feature_rows(findings)
    least, most = rows.agg(F.min("label"), F.max("label")).first()
    if least is None or least == most:
        return _constant(least or 0.0)
    return written_out(fitted(rows, trees, depth, seed))


def fitted(rows: DataFrame, trees: int, depth: int, seed: int) -> RandomForestClassificationModel:
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(vectors)


def written_out(model: RandomForestClassificationModel) -> Forest:
    """The model's trees as arrays."""
    feature, threshold, child, value, roots = [], [], [], [], []

    def place(node) -> None:
        feature.append(0)
        threshold.append(0.0)
        child.append(0)
        counts = list(node.impurityStats().stats())
        value.append(counts[1] / sum(counts))

    for tree in model.trees:
        roots.append(len(feature) + 1)
        place(tree._java_obj.rootNode())
        open_ = [(tree._java_obj.rootNode(), roots[-1])]
        for node, at in open_:  # grows while it is walked
            if node.subtreeDepth() == 0:
                continue
            feature[at - 1] = node.split().featureIndex() + 1
            threshold[at - 1] = node.split().threshold()
            child[at - 1] = len(feature) + 1
            for below in (node.leftChild(), node.rightChild()):
                place(below)
                open_.append((below, len(feature)))
    joined = [",".join(map(repr, v)) for v in (roots, feature, threshold, child, value)]
    return Forest(joined[0], max(t.depth for t in model.trees), *joined[1:])


def _scored(docs: DataFrame, forest: Forest, path: str | None) -> DataFrame:
    asked = ", ".join(f"c.{x}" for x in FEATURES)
    scored = f"element_at(transform(array(array({asked})), f -> {forest.score()}), 1)"
    return _with_features(docs, "text", path).selectExpr(
        *[f"`{c}`" for c in docs.columns],
        "__values",
        "__pieces",
        f"transform(__features, c -> {scored}) AS __scores",
    )


def findings(docs: DataFrame, forest: Forest, path: str | None = None) -> DataFrame:
    """One row per candidate: ``doc_id``, its ``place`` among the document's candidates, ``value``,
    ``score`` and whether it ``is_secret``."""
    slim = docs.select("doc_id", "text", *([F.col(path).alias("__path")] if path else []))
    scored = _scored(slim, forest, "__path" if path else None)
    out = scored.selectExpr("doc_id", "posexplode(arrays_zip(__values, __scores)) AS (place, found)")
    out = out.selectExpr("doc_id", "place", "found.__values AS value", "found.__scores AS score")
    return out.withColumn("is_secret", F.col("score") >= 0.5)


def redact(docs: DataFrame, forest: Forest, path: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by ``mark``; all columns stay, ``n_chars`` follows."""
    scored = _scored(docs, forest, path)
    rebuilt = f"""concat(array_join(transform(arrays_zip(__pieces, __values, __scores),
        z -> concat(z.`__pieces`, CASE WHEN z.`__scores` >= 0.5 THEN '{mark}' ELSE coalesce(z.`__values`, '') END)), ''))"""
    out = scored.withColumn(
        "text", F.expr(f"CASE WHEN exists(__scores, s -> s >= 0.5) THEN {rebuilt} ELSE text END")
    )
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn(
            "n_chars", F.expr(f"CASE WHEN exists(__scores, s -> s >= 0.5) THEN CAST(length(text) AS {kind}) ELSE n_chars END")
        )
    return out.select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: secrets are replaced in the text."""
    return redact(docs, train(labelled_findings(spark)), "source" if "source" in docs.columns else None)
