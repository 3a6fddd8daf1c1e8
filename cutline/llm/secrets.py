"""Secret scans: candidate strings in texts, and a random forest that removes the false positives, in SQL functions only.

Candidates are found by one expression, from left to right: the password of an address (``scheme://user:password@``, either of up to 256 characters), the body of a private key below its headers,
what stands in quotes, blanks included, after a name for passwords and a sign, or between tags named so, what stands after
``=`` or ``:`` (at least ``SHORTEST_ASSIGNED`` characters other than white space, in quotes or up to white space, or to ``,``, ``;`` or ``&`` where a name and a sign follow), and
elsewhere tokens of at least ``SHORTEST`` letters, digits and key characters with a digit among them. The text is cut up at its candidates, so each
stands at its own place between the words before and after it, however often its value occurs. A candidate's features: length and kinds of
characters, transitions between kinds, repeats, coverage by dictionary words, neighbouring words, known key prefixes, and the path (here: the source) it was found under. A
random forest learns from labelled findings and is walked by one SQL expression, the mean of its trees' leaves. So extraction, features, scores and redaction
are expressions in the row of their document: no explode before the result, no shuffle.

The labelled findings come from rules (``labelled_findings``): values, names and lines are drawn independently of each other, and a second set of names, words and line forms is held
out to measure by. Any table with their columns can take their place, and any list of words that of the dictionary.

Null texts have no candidates; a value that repeats in a text is reported and redacted at each place on its own; repeated rows give repeated findings; a null source is an empty path; passwords that a command's option takes without a sign (``-p...``) are tokens like others; texts
of any length are read whole (loops of the expression are possessive or bounded); an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

SHORTEST, SHORTEST_ASSIGNED, THRESHOLD = 12, 4, 0.5
TREES, DEPTH, FINDINGS, SEED = 24, 8, 6000, 11

_KEY = r"[A-Za-z0-9+/_-]"
_NAME = r"""[A-Za-z0-9_.$\[\]"'`\\-]"""
#: A sign and what may stand between it and a value.
_SIGN = r"""[=:]++>?+[ \t]{0,8}+\\?+"""
#: The password of an address; the body of a private key.
ADDRESS = r"""://[^\s/:@]{0,256}+:(?:[^\s/]{3,256}@|(?!\d{1,5}[/?#])[^\s@"'<>]{3,256}@(?=[A-Za-z0-9\[]))"""
_BEGIN = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?+-----(?:\s{1,4}+[A-Z][A-Za-z-]{1,30}+: [^\r\n]{0,200}+){0,8}+"
KEY_BLOCK = _BEGIN + r"[A-Za-z0-9+/=\s]{16,}+"
#: What names a password before a sign; a quoted value after one may hold blanks, and one between tags named so needs no sign.
_PASS = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|kennwort|passwort)"
_QUOTED = "|".join(rf"{q}[^{q}\s]{{{SHORTEST_ASSIGNED},}}+{q}" for q in "\"'`")
#: Without quotes a value is no address and no further name and sign; it ends before white space, or where a separator is followed by a name and a sign, and may hold 400 inner separators at most (a bound of the expression's stack).
_BARE = rf"""(?!//)(?!["'`])(?![A-Za-z0-9_.$-]{{1,64}}+["'`\])]{{0,2}}+(?:=(?!=*+(?:[\s,;&"'`)\]}}]|$))|:))(?=[^\s,;&]{{{SHORTEST_ASSIGNED}}})[^\s,;&"'`]++(?:[,;&](?!{_NAME}*+[ \t]*+[=:])[^\s,;&"'`]++){{0,400}}+"""
SIGNED = rf"{_SIGN}(?:{_QUOTED}|[\"'`]?+{_BARE})"
#: A token that is no name before a sign; beside a word for keys it needs no digit.
TOKEN = rf"""(?<!{_KEY})(?:(?=[A-Za-z+/_-]*+[0-9])|(?<=earer |oken |ecret |sword )(?={_KEY}{{20}})){_KEY}{{{SHORTEST},}}+(?!["'`\])]{{0,2}}+(?:[ \t]{{0,8}}+:|[ \t]{{1,8}}+=|={{1,2}}+>?+["'`]?+[^\s,;)\]}}"'`]))={{0,2}}+"""
PHRASE = rf"""(?=[=:])(?<={_PASS}["'`\])]{{0,2}}[ \t]{{0,4}}){_SIGN}(?:"[^"\r\n]{{4,200}}+"|'[^'\r\n]{{4,200}}+')"""
TAGGED = rf"(?=>)(?<=<{_PASS})>[^<\s]{{4,256}}+(?=</)"
CANDIDATE = rf"{ADDRESS}|{KEY_BLOCK}|{PHRASE}|{SIGNED}|{TAGGED}|{TOKEN}"
#: What of a candidate's match stands before its value, and after it.
_LEAD = rf"""^(?:://[^\s/:@]*+:|{_BEGIN}\s*+|{_SIGN}["'`]?+|>)"""
_MARKS = r"""[.)\]}>"'`\\:]"""
_TAIL = rf"""(?:@|{_MARKS}+|\s+)$"""

#: Words that stand beside keys, beside other identifiers, in paths of examples, in placeholders; issued prefixes.
KEY_WORDS = "pass|pwd|secret|token|auth|credential|(?:api|access|private|account|signing|encryption|client|master).?key|bearer|kennwort|clave"
OTHER_WORDS = "commit|sha|hash|md5|digest|checksum|uuid|guid|revision|isbn|order|invoice|card|phone|version|etag|build|serial|integrity|base64|fingerprint|blob"
EXAMPLE_PATHS = "test|example|sample|fixture|mock|demo|doc"
PLACEHOLDER = r"^[<{(\[$%]|\*\*|\.\.\.|^(.)\1+$|^(?:your|my|some|change|enter|insert)[-_A-Z]?"
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abps]-|sk-|sk_live_|rk_live_|AIza|eyJ|npm_|hf_"
#: Common words and word parts, of which names, prose and placeholders are made.
DICTIONARY = (
    "access account action active admin after alpha amount archive article author beta block bridge build button cache change class client code color common config connect content control "
    "data date debug default domain draft dummy empty enable english entry error event example expired field figure file final find first folder form format frame group guide hash head hello "
    "help here high history home host house image index info input invalid issue item key label lang large last left letter level library light limit line link list local log long machine "
    "main manager market media member memory ment message mode model month name network never next node none null number object open option order other owner page part pass path place point "
    "port post process profile query range read record release remote report request required reset root sample schema search second secret section select server service session setting "
    "short simple single source standard start state station string system table target test text the time title token tool top true type under unit update user value version video view "
    "water word work world your zone"
).split()

FEATURES = (
    "length", "digits", "upper", "symbols", "transitions", "repeats", "variety", "dictionary", "only_digits", "only_hex",
    "prefix", "assigned", "key_word", "other_word", "example_path", "other_symbols", "placeholder", "special",
)


def pieces(text: Column) -> Column:
    """array<string> that joins to text: what lies between candidates, and, at every second place, the candidates' matches."""
    mark = F.concat(F.lit("\x01"), F.md5(text.cast("binary")))  # stands in no text, as it would have to hold its own digest
    return F.split(F.regexp_replace(text, F.lit(CANDIDATE), F.concat(mark, F.lit("$0"), mark)), mark, -1)


def _parts(found: Column, i: Column) -> Column:
    """struct<lead, value, tail, before, after, kind> of the match at place i."""
    match = F.get(found, i)

    def cut(lead: Column) -> Column:
        rest = F.substring(match, F.length(lead) + 1, F.length(match))

        def around(tail: Column) -> Column:
            kind = F.when(lead.startswith("://"), "address").when(lead.startswith("-----"), "block").when(lead != "", "assigned").otherwise("token")
            near = F.concat(F.right(F.coalesce(F.get(found, i - 2), F.lit("")), F.lit(48)), F.right(F.get(found, i - 1), F.lit(96)))
            return F.struct(
                lead.alias("lead"), F.substring(rest, F.lit(1), F.length(rest) - F.length(tail)).alias("value"), tail.alias("tail"),
                F.regexp_extract(near, r"((?:\S{1,64}\s{1,3})?\S{1,64})\s{0,8}$", 1).alias("before"),
                F.regexp_extract(F.left(F.coalesce(F.get(found, i + 1), F.lit("")), F.lit(48)), r"""^["']?[,.;]? ?([A-Za-z]{2,30})""", 1).alias("after"),
                kind.alias("kind"),
            )

        return let(F.when(lead == "", F.lit("")).otherwise(F.regexp_extract(rest, _TAIL, 0)), around)

    return let(F.regexp_extract(match, _LEAD, 0), cut)


def candidates(text: Column) -> Column:
    """array<struct<lead, value, tail, before, after, kind>> of a text."""
    return let(pieces(text), lambda found: F.transform(_odd(found), lambda i: _parts(found, i)))


def _odd(found: Column) -> Column:
    """The places of the matches."""
    return F.when(F.size(found) > 1, F.sequence(F.lit(1), F.size(found) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))


def features(c: Column, path: Column, words: list[str] = DICTIONARY) -> Column:
    """array<double>: the forest's inputs, in the order of FEATURES, of a candidate's whole value and the path it stands under."""
    prepared = F.struct(
        c["value"].alias("value"), c["kind"].alias("kind"), F.lower(F.concat_ws(" ", c["before"], c["after"])).alias("beside"),
        F.greatest(F.length(c["value"]), F.lit(1)).cast("double").alias("n"),
    )
    return let(prepared, lambda x: F.array(*_inputs(x, path, words)))


def _inputs(c: Column, path: Column, words: list[str]) -> list[Column]:
    v, beside, n = c["value"], c["beside"], c["n"]
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    known = "|".join(map(re.escape, sorted(words, key=len, reverse=True)))
    return [
        F.length(v).cast("double"), share("[0-9]"), share("[A-Z]"), share("[+/_=-]"),
        share("(?<=[a-z])[0-9A-Z]|(?<=[0-9])[A-Za-z]|(?<=[A-Z])[0-9a-z]"),
        share(r"(.)(?=\1)"),
        F.size(F.array_distinct(F.split(v, ""))) / n,
        1 - F.length(F.regexp_replace(F.lower(v), F.lit(known), F.lit(""))) / n,
        flag(v.rlike("^[0-9]+$")), flag(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), flag(v.rlike(f"^(?:{PREFIXES})")),
        flag(c["kind"] == "assigned"), flag(beside.rlike(KEY_WORDS)), flag(beside.rlike(OTHER_WORDS)),
        flag(F.lower(path).rlike(f"(?:^|[^a-z])(?:{EXAMPLE_PATHS})")),
        share("[^A-Za-z0-9+/_=-]"), flag(v.rlike(f"(?i){PLACEHOLDER}")), flag(c["kind"].isin("address", "block")),
    ]


#: Words that the rules draw from: for learning, and held out.
_NAMES = (
    "password passwd pwd db_password user-password --password admin.password secret DB_PASS token x-auth-token auth_token api_key apiKey client-secret s3_secret db2_admin_password access_token AWS_SECRET_ACCESS_KEY",
    "userPassword mysql_pwd PGPASSWORD root.passwd app-secret SECRET_KEY refreshToken oauth_token master-key api.key smtp_pass private_key credential ftp2_password Passwort",
)
_OTHER = ("commit sha checksum revision etag build order invoice card phone uuid version", "sha256 md5sum digest guid serial isbn hash fingerprint blob changeset-hash order_id integrity")
_PLAIN = ("note width mode lang timeout charset said place data-id level2 http the", "title height status region retries encoding asked city row-key layer3 ftp and")
_PROSE = ("the station und under pour between con market", "a river oder over avec among sin garden")
_WORDS = ("development english enabled however Monday utf-8 market station localhost:8080 left,right production", "staging spanish disabled therefore Friday ascii garden-path example.org:443 up,down nightly maximum")
_HUMAN = ("hunter dragon Summer letmein Monkey qwerty blue shadow P@ss S3cr$t W!nter kx#9", "falcon tiger Spring welcome Turtle asdfgh green ghost Pa$$w Gehe!m Q!ang zv&7")
_CAMEL = ("Correct Purple Silent Copper Winter Horse Tiger River Stone Battery Staple Window", "Golden Broken Hidden Marble Autumn Eagle Canyon Valley Lantern Thunder Pepper Castle")
_PHRASES = (
    "enter your password here|must not be empty|change this value|see the manual|at least eight characters|not set yet",
    "type the new password|cannot be blank|replace this text|ask your administrator|use a long phrase|to be defined",
)
_HOLDERS = (
    "required string none null your-password <token> ${PASSWORD} {password} ******** changeme example optional xxxxxxxx placeholder the expired missing .... your_token_here example_token_123 123456789012",
    "mandatory text empty undefined your-secret <secret> $(SECRET) %PASS% xxxx-xxxx change_this sample insert_here00 yyyyyyyy dummy a invalid hidden ---- my_api_key_here test_key_0000 000000000000",
)
_LINES = (["{n}{s}{v} {p}", "{p} {n}{s}{v}", '{n}{s}"{v}" {p}', "{{\"{n}\": \"{v}\"}} {p}", "export {n}={v}", "{p} {p}, {n}{s}{v}, {p}"], ["set {n}{s}{v};", "- {n}: {v}", "'{n}' => '{v}',", '  "{n}" : "{v}", {p}', "{n}{s}'{v}' # {p}", "{p} {p}: {n}{s}{v}."])
_SIGNS = ("= |: | = |:|=", " := |=|: | : |=")
_SOURCES = ("corpus/part.txt src/main.py app/settings.ini", "lib/server.go deploy/values.yaml data/raw.csv")
_EXAMPLES = ("tests/fixtures/data.txt docs/readme.md", "examples/demo.py spec/mock_server.rb")


def labelled_findings(spark: SparkSession, n: int = FINDINGS, held_out: bool = False) -> DataFrame:
    """line, path, value and label (1: a secret), n of them; held_out draws from other names, words and forms of lines, and other random values.

    Keys as services issue them, passwords of addresses and key blocks are secrets everywhere, random strings beside words for keys too; what people make up counts as one where it
    is assigned to a name for keys outside of tests and documents. Hashes, identifiers, numbers, words and placeholders are none, whatever they are assigned to.
    """
    side = int(held_out)
    i, draw = F.col("id"), lambda salt: F.xxhash64(F.col("id"), F.lit(f"{salt}:{side}"))
    many = lambda pool: pool if isinstance(pool, list) else pool.split("|") if "|" in pool else pool.split()
    pick = lambda salt, pool: F.element_at(F.array(*map(F.lit, many(pool[side]))), (F.pmod(draw(salt), F.lit(len(many(pool[side])))) + 1).cast("int"))
    between = lambda salt, low, high: (low + F.pmod(draw(salt), F.lit(high - low + 1))).cast("int")
    digest = lambda salt: F.concat(*(F.sha2(F.concat_ws(":", F.lit(f"{salt}{k}{side}"), i.cast("string")), 256) for k in range(2)))
    left = lambda text, k: F.left(text, k if isinstance(k, Column) else F.lit(k))
    hexed = lambda salt, k: left(digest(salt), k)
    base64 = lambda salt, k: left(F.translate(F.base64(F.unhex(digest(salt))), "+/=\r\n", "Aq7"), k)
    base32 = lambda salt, k: left(F.upper(F.translate(digest(salt), "0189", "wxyz")), k)
    digits = lambda salt, k: left(F.translate(digest(salt), "abcdef", "012345"), k)
    human = F.concat(pick("h", _HUMAN), F.element_at(F.array(*map(F.lit, ("", "!", "_", "#"))), between("hs", 1, 4)), digits("hd", between("hk", 1, 4)))
    camel = F.concat(pick("c1", _CAMEL), pick("c2", _CAMEL), pick("c3", _CAMEL))
    issued = F.concat(F.element_at(F.array(*(F.concat(F.lit(p), v) for p, v in (("AKIA", base32("a", 16)), ("ghp_", base64("g", 36)), ("sk-", base64("s", 40)), ("xoxb-", digits("x", 24)), ("AIza", base64("z", 35))))), between("i", 1, 5)))
    uuid = F.concat_ws("-", hexed("u1", 8), hexed("u2", 4), F.concat(F.lit("4"), hexed("u3", 3)), F.concat(F.lit("a"), hexed("u4", 3)), hexed("u5", 12))
    number = F.concat(digits("n", between("nk", 4, 16)), F.element_at(F.array(*map(F.lit, ("", "px", ".5", "ms"))), between("nu", 1, 4)))
    made = F.concat_ws("-", F.lower(pick("m1", _CAMEL)), F.lower(pick("m2", _CAMEL)), digits("md", between("mk", 2, 6)))
    key, other, plain, prose = pick("kn", _NAMES), pick("on", _OTHER), pick("pn", _PLAIN), pick("pr", _PROSE)
    assigned, bare, beside = pick("ln", _LINES), F.lit("{p} {v} {p}"), F.lit("{p} {n} {v} {p}")
    true, example = pick("sp", _SOURCES), pick("ep", _EXAMPLES)
    anywhere = F.when(F.pmod(draw("any"), F.lit(3)) == 0, example).otherwise(true)
    word = lambda *w: F.element_at(F.array(*map(F.lit, w)), between("w", 1, len(w)))
    rules = [  # label, value, line, name, path
        (1, issued, bare, prose, anywhere), (1, issued, assigned, key, anywhere), (1, issued, assigned, plain, anywhere),
        (1, base64("r", between("rk", 20, 60)), assigned, key, true), (1, base64("q", between("qk", 24, 48)), beside, word("Bearer", "token", "secret", "password"), true),
        (1, hexed("f", between("fk", 16, 64)), assigned, key, true), (1, base64("e", between("ek", 8, 19)), assigned, key, true),
        (1, human, assigned, key, true), (1, camel, assigned, key, true), (1, human, F.lit("{p} postgres://{n}:{v}@db.host:5432/{p}"), prose, anywhere), (1, base64("y", between("yk", 8, 20)), F.lit("url: https://{n}:{v}@host/{p}"), prose, anywhere),
        (1, F.lower(F.concat_ws(" ", pick("w1", _CAMEL), pick("w2", _CAMEL), pick("w3", _CAMEL), pick("w4", _CAMEL))), F.lit('{p} password = "{v}" {p}'), key, true), (0, pick("pz", _PHRASES), F.lit('{p} password: "{v}" {p}'), key, anywhere),
        (1, human, F.lit("{p} <password>{v}</password> {p}"), key, true), (0, pick("ph3", _HOLDERS), F.lit("{p} <secret>{v}</secret> {p}"), key, anywhere),
        (1, F.concat_ws("\n", *(base64(f"b{k}", 64) for k in range(3))), F.lit("-----BEGIN RSA PRIVATE KEY-----\n{v}\n-----END RSA PRIVATE KEY-----"), key, anywhere),
        (0, hexed("h1", between("hl", 12, 64)), assigned, other, anywhere), (0, hexed("h2", between("hm", 12, 40)), beside, other, anywhere), (0, uuid, bare, prose, anywhere), (0, uuid, assigned, other, anywhere), (0, uuid, assigned, plain, anywhere),
        (0, digits("d1", between("dk", 12, 19)), bare, prose, anywhere), (0, digits("d2", between("dl", 8, 19)), assigned, other, anywhere), (0, base64("o", between("ok", 32, 64)), beside, word("base64", "integrity", "digest", "blob"), anywhere),
        (0, pick("pw", _WORDS), assigned, plain, anywhere), (0, number, assigned, plain, anywhere), (0, number, assigned, other, anywhere), (0, made, bare, prose, anywhere), (0, made, assigned, plain, anywhere),
        (0, pick("ph", _HOLDERS), assigned, key, anywhere), (0, pick("ph2", _HOLDERS), assigned, key, anywhere), (0, F.concat(F.lit("AKIA"), base32("v", 8), F.lit("1EXAMPLE")), bare, prose, anywhere),
        (0, human, assigned, key, example), (0, camel, assigned, key, example), (0, F.concat_ws("/", F.lit("home"), F.lower(pick("p1", _CAMEL)), digits("p2", 4), F.lower(pick("p3", _CAMEL))), bare, prose, anywhere),
    ]
    options = F.array(*(F.struct(F.lit(float(label)).alias("label"), v.alias("value"), line.alias("line"), name.alias("name"), path.alias("path")) for label, v, line, name, path in rules))
    drawn = spark.range(n).select("id", F.element_at(options, (F.pmod(i, F.lit(len(rules))) + 1).cast("int")).alias("r"), pick("si", _SIGNS).alias("sign"), prose.alias("prose"))
    line = F.replace(F.replace(F.replace(F.replace("r.line", F.lit("{n}"), F.col("r.name")), F.lit("{s}"), F.col("sign")), F.lit("{p}"), F.col("prose")), F.lit("{v}"), F.col("r.value"))
    return drawn.select(F.replace(F.replace(line, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")).alias("line"), F.col("r.path").alias("path"), F.col("r.value").alias("value"), F.col("r.label").alias("label"))


def is_value(c: Column, value: Column) -> Column:
    """Is a candidate the value of a labelled line, the marks at its end aside?"""
    bare = lambda x: F.regexp_replace(x, rf"(?:{_MARKS}|\s)+$", "")
    return bare(c["value"]) == bare(value)


def forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[list[str]]:
    """The trees of a forest trained on labelled findings (line, path, value, label), as Spark prints them, a list of lines each. A line's candidates other than its value are not learned from."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    found = findings.select("path", "label", "value", F.explode(candidates(F.col("line"))).alias("c")).filter(is_value(F.col("c"), F.col("value")))
    named = found.withColumn("f", features(F.col("c"), F.col("path"))).select("label", *(F.col("f")[i].alias(n) for i, n in enumerate(FEATURES)))
    model = RandomForestRegressor(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8, featureSubsetStrategy="onethird")
    text = model.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(named.coalesce(1))).toDebugString
    return [[x.strip() for x in part.splitlines()[1:] if x.strip()] for part in re.split(r"(?m)^\s*Tree \d+", text)[1:]]


_FITTED: dict[tuple, list[list[str]]] = {}


def own_forest(spark: SparkSession) -> list[list[str]]:
    """The forest of the rules' findings. They are the same whatever the tables, so it is fitted once in a process."""
    key = (FINDINGS, TREES, DEPTH, SEED)
    if key not in _FITTED:
        _FITTED[key] = forest(labelled_findings(spark))
    return _FITTED[key]


def _nodes(trees: list[list[str]]) -> tuple[list[dict], list[int], int]:
    """All trees' nodes in one table (feature or -1, threshold, left, right, value of a leaf), the places of the roots, and the greatest depth."""
    nodes: list[dict] = []

    def read(lines: list[str], at: int) -> tuple[int, int, int]:
        place = len(nodes)
        nodes.append({})
        if m := re.match(r"Predict: (\S+)", lines[at]):
            nodes[place] = {"f": -1, "t": 0.0, "l": place, "r": place, "v": float(m[1])}
            return place, at + 1, 0
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at])
        left, at, low = read(lines, at + 1)
        right, at, high = read(lines, at + 1)  # after its line "Else"
        nodes[place] = {"f": int(m[1]), "t": float(m[2]), "l": left, "r": right, "v": 0.0}
        return place, at, 1 + max(low, high)

    found = [read(lines, 0) for lines in trees]
    return nodes, [r[0] for r in found], max((r[2] for r in found), default=0)


def score(f: Column, trees: list[list[str]]) -> Column:
    """The forest over an array of features: the mean of the leaves that they lead to. The trees are a literal table that the expression walks, so its size is not the forest's."""
    nodes, roots, depth = _nodes(trees)
    table = F.from_json(F.lit(json.dumps(nodes)), "array<struct<f:int,t:double,l:int,r:int,v:double>>")  # folded to a constant
    step = lambda i, _: let(F.get(table, i), lambda n: F.when(n["f"] < 0, i).when(F.get(f, n["f"]) <= n["t"], n["l"]).otherwise(n["r"]))
    leaf = lambda root: F.get(table, F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), root, step))["v"]
    return F.aggregate(F.array(*map(F.lit, roots)), F.lit(0.0), lambda total, root: total + leaf(root)) / len(trees)


def scanned(text: Column, path: Column, trees: list[list[str]]) -> Column:
    """struct<pieces, found>: a text's pieces, and the candidates at every second place with their scores."""

    def scored(c: Column) -> Column:
        return F.struct(*(c[k].alias(k) for k in ("lead", "value", "tail", "before", "after", "kind")), let(features(c, path), lambda f: score(f, trees)).alias("score"))

    return let(pieces(text), lambda p: F.struct(p.alias("pieces"), F.transform(_odd(p), lambda i: let(_parts(p, i), scored)).alias("found")))


def findings(text: Column, path: Column, trees: list[list[str]]) -> Column:
    """array<struct<lead, value, tail, before, after, kind, score>> of all candidates of a text, in order; empty for null."""
    return F.coalesce(scanned(text, path, trees)["found"], F.array())


def redacted(scan: Column, mark: str = "[secret]", threshold: float = THRESHOLD) -> Column:
    """The text of a ``scanned`` one with each confirmed finding replaced by mark at its own place; null for null."""

    def shown(piece: Column, i: Column) -> Column:
        c = F.get(scan["found"], (i / 2).cast("int"))
        return F.when((i % 2 == 1) & (c["score"] >= threshold), F.concat(c["lead"], F.lit(mark), c["tail"])).otherwise(piece)

    return F.array_join(F.transform(scan["pieces"], shown), "")


def cleaned(text: Column, path: Column, trees: list[list[str]]) -> Column:
    """A text with its confirmed findings redacted; null for null."""
    return let(scanned(text, path, trees), lambda scan: redacted(scan))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with its score and whether it is a secret."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # the outer form, as for the plain one the optimizer adds a filter below it that evaluates all findings a second time
    found = docs.select("doc_id", F.posexplode_outer(findings(F.col("text"), F.col("source"), own_forest(spark))).alias("place", "c")).filter("c is not null")
    return found.select("doc_id", "place", "c.value", "c.before", "c.after", "c.kind", "c.score", (F.col("c.score") >= THRESHOLD).alias("secret"))
