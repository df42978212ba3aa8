"""Secret scan: candidates by shape, judged by a random forest, in DataFrame operations alone.

A text is cut into values that are assigned to a name like that of a credential or stand as a password
in a URL, runs of key characters, white space, and other characters. Such a value of any characters and
four of them or more, and every run of at least ``LEAST``, is a candidate. Its features are its length, the
mix and transitions of its characters, how much of it dictionary words cover, words in its path, and the
neighbouring words. The forest is grown on labelled findings (a bounded list, by default the generated one
below), whose features come from the same expressions, and becomes a tree of conditions. All of a document is judged
and redacted within its row: nothing is shuffled or grouped, and one pass is linear in the text.

Defined cases: a null text has no candidates and stays null; a null path says nothing; long texts and
repeated rows need no special care; each candidate is judged by itself, equal ones with equal neighbours
alike; a score of exactly the threshold is a secret; other columns may have any names.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .forest import Tree, forest_column, grow_forest

LEAST = 16
RUN = "[A-Za-z0-9_+/-]"
NAME = r"(?:tokens?|secrets?|passw(?:or)?d|passphrase|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|signing[_-]?key|secret[_-]?key|auth|credentials?)"
ASSIGN = r"[\"'`]?[\x20\x09]{0,2}(?:=>|[=:])[\x20\x09]{0,2}[\"'`]?"
SIGN = r"\x20\x09-\x0D\"'`,;<>(){}\[\]"
NAMED = rf"(?<=(?i:{NAME}){ASSIGN})[^{SIGN}=:][^{SIGN}]{{3,}}"
USER = r"://[^\x20\x09-\x0D/:@]{1,40}:"
IN_URL = rf"(?<={USER})[^\x20\x09-\x0D/@:]{{4,}}(?=@)"
PARTS = rf"{NAMED}|{IN_URL}|{RUN}+={{0,2}}|[\x20\x09-\x0D]+|(?:(?!{NAMED}|{IN_URL})[^A-Za-z0-9_+/\x20\x09-\x0D-])+"
MASK = "[SECRET]"
THRESHOLD = 0.5
#: Labelled findings that training uses at most.
MAX_FINDINGS = 5_000

_WORDS = "about account action active address admin after again align allow amount apple array async author back band base basic batch been before begin between block board body book border bottom box branch browser buffer build button cache call cell center chain change channel check child choose city class clean clear client clock close cloud code color column common company complete config connect content context control copy core count country create cross current custom data date debug default delete demo deploy detail device digit direct disable display document domain double down draft drive driver edge edit element email empty enable end engine enter entry error event every example export extra fail false feature fetch field figure file fill filter final find first fixed float flow focus folder font footer force form format found frame from front full function game general get global graph green grid group guide handle hash head header health height hello help hidden home host hour html image import index info init inner input insert install instance int internal item join json key kind label language large last layer layout left length letter level library light like limit line link list load local lock log login logo long loop machine main make manage map margin mark master match media member memory menu merge message method minor mobile mode model module money month more mouse move name native need network never next node normal north note null number object offset online open option order other output owner page panel paper parent part pass patch path pattern people phone photo picture place plain plan play plugin point policy pool port post power press preview price primary print private process product profile program project proxy public push query queue quick radio random range rate read ready record red reduce region release remote remove render repeat replace report request reset resource rest result return review right role room root round route row rule run safe sample save scale scan schema scope score screen script scroll search section select send serial series server service session set shape share shift short show side sign simple single site size skip small snap socket some sort source space spec split stack staff stage standard start state static status step stock stop storage store stream street string style submit success super support switch symbol sync system table tag target task team template term test text theme this thread time title today toggle tool top total touch trace track transfer tree trigger true type under union unit update upload user valid value vector version video view visible visit wait warn water web week white wide width window with word work world write year yellow your zone".split()
_BIGRAMS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
NEAR_KEY = r"token|secret|passw|pwd|api.?key|apikey|auth|bearer|credential|private.?key|access.?key|client.?key|signing|encrypt|webhook"
NEAR_OTHER = r"sha-?1|sha-?256|sha-?512|md5|commit|checksum|digest|hash|uuid|guid|revision|integrity|etag|version|isbn|order|invoice|placeholder|dummy|image|png|jpe?g|https?:|call|card|serial|trace|request|blob|tree|parent"
NEAR_SAMPLE = r"example|sample|test|mock|fixture|dummy|placeholder|redacted|xxxx|your[_-]|changeme|lorem"
FEATURES = ("length", "digits", "upper", "lower", "marks", "switches", "bigrams", "covered", "hex", "distinct", "known_form", "assigned", "quoted", "near_key", "near_other", "near_sample", "path_sample", "path_config", "named", "in_url", "others")


@functools.cache
def labelled_findings(n: int = 3_000, seed: int = 11) -> list[tuple[str, str, int]]:
    """Generated findings (path, text around one candidate, is a secret), half of each kind.

    Secrets are keys of common forms and random strings that are assigned to something named like a
    credential; the rest are what scanners report by mistake: digests, ids, numbers, names, samples.
    """
    r = random.Random(seed)
    hexa, low, alnum, b64 = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    chars = lambda a, k: "".join(r.choice(a) for _ in range(k))

    def digit(make) -> str:
        x = make()
        while not any(c.isdigit() for c in x):
            x = make()
        return x

    def password() -> str:
        """As people choose them: words, digits and signs, or short random strings."""
        if r.random() < 0.3:
            x = chars(alnum + "!@#$%^&*?._-", r.randint(8, 15))
        else:
            x = "".join(r.choice((str.title, str.lower))(r.choice(_WORDS)) for _ in range(r.randint(1, 3))) + r.choice(("", *"!@#$*?._-")) + str(r.randint(1, 9999)) + r.choice(("", "", *"!@#$*?"))
            for a, b in ("a@", "o0", "e3", "i1", "s$"):
                x = x.replace(a, b) if r.random() < 0.25 else x
        return x if len(x) >= 6 else password()

    say = lambda k: " ".join(r.choice(_WORDS) if r.random() < 0.5 else chars(low, r.randint(2, 9)) for _ in range(k))
    keys = [
        lambda: chars(hexa, r.choice((32, 40, 40, 48, 64))), lambda: chars(alnum, r.randint(20, 64)), lambda: chars(b64, r.randint(30, 86)) + r.choice(("", "=", "==")),
        lambda: "AKIA" + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: r.choice(("ghp_", "gho_", "ghs_")) + chars(alnum, 36), lambda: "xoxb-" + chars("0123456789", 12) + "-" + chars(alnum, 24),
        lambda: r.choice(("sk_live_", "rk_live_")) + chars(alnum, 24), lambda: "AIza" + chars(alnum + "-_", 35), lambda: "glpat-" + chars(alnum, 20), lambda: "eyJ" + chars(alnum, r.randint(40, 90)),
        lambda: chars(alnum[:52], r.randint(16, 44)), lambda: chars(low, r.randint(20, 40)),
    ]
    own = ["password", "passwd", "pwd", "secret", "db_password", "PASSWORD", "token", "admin_pwd", "auth", "passphrase"]
    set_to = [' = "{}"', " = '{}'", ": {}", '="{}"', "={}", ': "{}"', ' => "{}"', " = {}"]
    plain = ["required", "None", "null", "true", "false", "string", "invalid", "expired", "missing", "optional", "undefined", "getpass()", "os.environ", "config.secret", "self.token", "user.password", "process.env.TOKEN", "${PASSWORD}", "%(password)s", "{{token}}", "$TOKEN", "********", "xxxxxx", "<password>", "changeme", "your-password", "example", "test", "forgotten", "request.args", "args.token", "str(token)", "hidden", "bearer", "basic", "input", "text/plain"]
    names = ["token", "secret", "password", "passwd", "api_key", "apikey", "API-KEY", "auth_token", "access_key", "client_secret", "private_key", "Authorization: Bearer", "credential", "signing_key", "webhook secret", "TOKEN", "SECRET_KEY"]
    joins = [' = "{}"', " = '{}'", ": {}", '="{}"', "={}", ': "{}"', " {}", ' => "{}"', " is {}"]
    mistakes = [
        lambda: f"{r.choice(('commit', 'revision', 'parent', 'tree', 'blob', 'merged'))} {digit(lambda: chars(hexa, 40))}", lambda: f"{r.choice(('sha256', 'sha1', 'md5', 'checksum', 'digest', 'etag', 'hash'))}{r.choice((': ', '=', ' ', '-'))}{digit(lambda: chars(hexa, r.choice((32, 40, 64))))}",
        lambda: f'integrity="sha512-{digit(lambda: chars(b64, 86))}=="', lambda: f"{r.choice(('id', 'uuid', 'request', 'trace', 'guid', 'session id', ''))} {digit(lambda: '-'.join(chars(hexa, k) for k in (8, 4, 4, 4, 12)))}",
        lambda: f"{r.choice(('card', 'order', 'invoice', 'call', 'serial', 'account', '', '', ''))} {chars('0123456789', r.randint(16, 22))}", lambda: f"{r.choice(('call', 'see', 'function', 'import', ''))} {'_'.join(r.choice(_WORDS) for _ in range(4))}_{r.randint(1, 99)}",
        lambda: f"{r.choice(('class', 'new', 'use', ''))} {''.join(r.choice(_WORDS).title() for _ in range(4))}{r.randint(1, 9)}Value", lambda: f"https://host.org/{'/'.join(r.choice(_WORDS) for _ in range(4))}/{r.randint(10, 99999)}/{r.choice(_WORDS)}",
        lambda: f"{r.choice(names)}{r.choice(joins).format(r.choice(('xxxxxxxxxxxxxxxx1', 'your-api-key-goes-here-1', 'example_token_value_123', 'changeme_changeme_123', 'sample-secret-key-0000', 'placeholder0placeholder', '0000000000000000', '1234567890123456', 'test_test_test_1234')))}",
        lambda: f"{r.choice(names)}{r.choice(joins).format('_'.join(r.choice(_WORDS) for _ in range(4)) + str(r.randint(1, 99)))}", lambda: f"image/png;base64,{digit(lambda: chars(b64, r.randint(60, 200)))}", lambda: f"{chars(low, r.randint(8, 14))}{r.randint(10, 99)}-{chars(low, r.randint(6, 12))}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}", lambda: f"{r.choice(names)} {say(4)} {chars('0123456789', 16)}", lambda: f"{chars(hexa[:10], r.randint(16, 30))}",
    ]
    paths = ["src{}", "lib/core{}.py", "config/prod{}.env", "web/app{}.js", "deploy/settings{}.yaml", "docs/page{}.md", ""]
    out = []
    for k in range(n):
        if k % 2:
            kind = r.random()
            if kind < 0.1:  # some forms tell by themselves
                body = say(1) + " " + digit(r.choice(keys[3:9]))
            elif kind < 0.35:
                body = r.choice(own) + r.choice(set_to).format(password())
            elif kind < 0.4:
                body = f"{r.choice(('postgres', 'mysql', 'https', 'redis', 'amqp'))}://{r.choice(('admin', 'root', 'user', r.choice(_WORDS)))}:{password().replace('@', '').replace('?', '')}@{r.choice(_WORDS)}.host:{r.randint(80, 9999)}/{r.choice(_WORDS)}"
            else:
                body = r.choice(names) + r.choice(joins).format(r.choice(keys)())
            path = r.choice(paths).format(r.randint(0, 30))
        else:
            body = r.choice(mistakes)()
            path = r.choice([*paths, *paths, "tests/test_auth{}.py", "examples/demo{}.md"]).format(r.randint(0, 30))
            if r.random() < 0.25:
                body = r.choice(own) + r.choice(set_to).format(r.choice((r.choice(plain), r.choice(plain), r.choice(_WORDS), r.choice(_WORDS) + "_" + r.choice(_WORDS), r.choice(_WORDS) + "." + r.choice(_WORDS), chars(low, r.randint(4, 9)))))
            elif r.random() < 0.15:  # long, but made of words, or said and not assigned
                body = say(1) + " " + r.choice(("/", "_", "-", "")).join(r.choice(_WORDS) if r.random() < 0.7 else chars("aeiou", 1) + chars(low, 2) + "er" for _ in range(r.randint(4, 6)))
            if r.random() < 0.08:  # a key in a test's fixtures
                body, path = r.choice(names) + r.choice(joins).format(digit(r.choice(keys[:3]))), r.choice(("tests/fixtures/mock{}.json", "spec/sample_example{}.rb")).format(r.randint(0, 30))
        out.append((path, f"{say(r.randint(0, 6))} {body} {say(r.randint(0, 6))}", k % 2))
    return out


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _features(c: Column, left: Column, right: Column, path: Column) -> Column:
    """The features of a run, as an array of doubles in the order of ``FEATURES``."""
    n = F.length(c)
    share = lambda chars: (n - F.length(F.translate(c, chars, ""))) / n
    small = F.lower(c)
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    near = F.lower(F.concat(left, F.lit(" "), right))
    return F.array(
        F.least(n, F.lit(200)).cast("double"),
        share("0123456789"),
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        share("abcdefghijklmnopqrstuvwxyz"),
        share("_+/-="),
        F.regexp_count(c, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / n,
        F.regexp_count(small, F.lit(f"(?={'|'.join(_BIGRAMS)})")) / n,
        1 - F.length(F.regexp_replace(small, "|".join(w for w in sorted(_WORDS, key=lambda w: (-len(w), w)) if len(w) > 2), "")) / n,
        flag(c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$")),
        F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(62)),
        flag(c.rlike("^(AKIA[A-Z0-9]{16}|gh[pos]_|xox[bp]-|[sr]k_live_|AIza|glpat-|eyJ)")),
        flag(left.rlike(r"([=:]|=>|\b[Bb]earer)[\x20\x09\"'`]*$")),
        flag(left.rlike(r"[\"'`]$") & right.rlike(r"^[\"'`]")),
        flag(F.lower(left).rlike(NEAR_KEY)),
        flag(near.rlike(NEAR_OTHER)),
        flag(F.concat(near, small).rlike(NEAR_SAMPLE)),
        flag(F.lower(path).rlike("test|example|mock|spec|fixture|sample|demo")),
        flag(F.lower(path).rlike(r"config|settings|deploy|prod|\.env")),
        flag(left.rlike(f"(?i:{NAME}){ASSIGN}$")),
        flag(left.rlike(f"{USER}$")),
        (n - F.regexp_count(c, F.lit("[A-Za-z0-9_+/=-]"))) / n,
    )


def _candidate(part: Column, parts: Column, i: Column) -> Column:
    """Whether the part numbered ``i`` is judged."""
    run = part.rlike(f"^{RUN}{{{LEAST},}}={{0,2}}$")
    # A value stands behind a sign, and white space at most; a name and its sign are six parts at most.
    behind_sign = F.concat(F.coalesce(F.get(parts, i - 2), F.lit("")), F.coalesce(F.get(parts, i - 1), F.lit(""))).rlike(r"[=:>\"'`][\x20\x09]*$")
    n = F.least(i, F.lit(6))
    named = F.array_join(F.slice(parts, i - n + 1, n), "").rlike(f"(?i:{NAME}){ASSIGN}$|{USER}$")
    return run | ((F.length(part) >= 4) & behind_sign & part.rlike(r"^[^\x20\x09-\x0D]*[A-Za-z0-9]") & named)


def _around(parts: Column, i: Column) -> tuple[Column, Column]:
    """What stands within eight parts before the part numbered ``i``, and six after."""
    before = F.least(i, F.lit(8))
    return F.array_join(F.slice(parts, i - before + 1, before), ""), F.array_join(F.slice(parts, i + 2, 6), "")


def scan(docs: DataFrame, forest: list[Tree], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", keep: Sequence[str] = ()) -> DataFrame:
    """``docs`` -> (id, redacted, findings), one row per input row, with the ``keep`` columns between.

    ``findings`` has (part, length, score, secret) for each candidate in the order of the text; ``redacted``
    is the text with the secrets masked.
    """
    text = F.col(text_col)
    path = F.coalesce(F.col(path_col), F.lit("")) if path_col else F.lit("")

    def judged(parts: Column, p: Column, i: Column) -> Column:
        left, right = _around(parts, i)
        return _let(_features(p, left, right, path), lambda f: forest_column(forest, lambda k: F.get(f, k)))

    def of(parts: Column) -> Column:
        def part(p: Column, i: Column) -> Column:
            return F.struct(p.alias("p"), F.when(_candidate(p, parts, i), judged(parts, p, i)).alias("score"), i.alias("i"))

        return F.transform(parts, part)

    # Other texts have no candidate.
    worth = F.coalesce(text.rlike(f"{RUN}{{{LEAST}}}") | text.rlike(f"(?i:{NAME}){ASSIGN}[^\\x20\\x09-\\x0D]|{USER}[^\\x20\\x09-\\x0D/@:]{{4,}}@"), F.lit(False))
    done = F.when(worth, _let(F.regexp_extract_all(text, F.lit(PARTS), F.lit(0)), of))
    rows = docs.select(F.col(id_col), *[F.col(c) for c in keep], _let(
        F.struct(text.alias("text"), done.alias("done")),
        lambda x: F.struct(
            F.coalesce(F.array_join(F.transform(x["done"], lambda d: F.when(d["score"] >= threshold, MASK).otherwise(d["p"])), ""), x["text"]).alias("redacted"),
            F.coalesce(
                F.transform(F.filter(x["done"], lambda d: d["score"].isNotNull()), lambda d: F.struct(d["i"].alias("part"), F.length(d["p"]).alias("length"), d["score"].alias("score"), (d["score"] >= threshold).alias("secret"))),
                F.expr("cast(array() as array<struct<part:int,length:int,score:double,secret:boolean>>)"),
            ).alias("findings"),
        ),
    ).alias("scanned"))
    return rows.select(id_col, *keep, "scanned.redacted", "scanned.findings")


def finding_features(findings: DataFrame) -> DataFrame:
    """(path, text, label) -> (features, label) of the first candidate of each text."""
    parts = F.regexp_extract_all("text", F.lit(PARTS), F.lit(0))

    def of(ps: Column) -> Column:
        rows = F.transform(ps, lambda p, i: F.struct(p.alias("p"), i.alias("i")))

        def features(x: Column) -> Column:
            left, right = _around(ps, x["i"])
            return _features(x["p"], left, right, F.col("path"))

        return F.get(F.transform(F.slice(F.filter(rows, lambda x: _candidate(x["p"], ps, x["i"])), 1, 1), features), F.lit(0))

    return findings.select(_let(parts, of).alias("features"), "label").filter(F.col("features").isNotNull())


def fit(spark: SparkSession, findings: Sequence[tuple[str, str, int]] | None = None, **shape) -> list[Tree]:
    """Grow the forest on at most ``MAX_FINDINGS`` labelled findings (path, text, label)."""
    rows = list(findings if findings is not None else labelled_findings())[:MAX_FINDINGS]
    measured = finding_features(spark.createDataFrame(rows, "path string, text string, label int")).collect()
    return grow_forest(np.array([r["features"] for r in measured], float), np.array([r["label"] for r in measured]), **shape)
