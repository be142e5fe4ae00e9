"""Secret scans: candidates by pattern, false positives removed by a random forest.

One pattern finds candidates in whole texts: known key formats, assignments to a telling name (whole names and
whole values, to the closing quote where there is one), credentials in addresses, private key blocks, and
long tokens with a digit or many changes of case. A candidate's features are its length, the changes between
kinds of characters, how much of it words cover (of a dictionary, and of sample values), how much it looks
like a path, and the words beside it. The forest is grown from labelled_findings(), on the driver, and applied
as one SQL expression; nothing here runs Python on executors.
"""

from __future__ import annotations

import json
import random
import string
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tokenizer_path

VOCABULARY = "word_bpe_49k.json"

KNOWN = (
    r"(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|"
    r"xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|"
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
)
_BEGIN, _END = (r"-----" + x + r" [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----" for x in ("BEGIN", "END"))
#: to the first END line, or, where none comes before the next block, the header and base64 lines that follow
PEM = _BEGIN + r"(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+" + _END + r"|(?:\s*+(?:(?:Proc-Type|DEK-Info|Version|Comment): [^\r\n]*+|[A-Za-z0-9+/=]{16,}+))++)"
ADDRESS = r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@\"'<>]*+:[^\s/@\"'<>]++@"
NAMES = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?|bearer)"
_OPERATOR = r"[\"'\]]{0,2}\s{0,3}(?::=|=>|[:=])\s{0,3}"
NAMED = r"[A-Za-z0-9_.-]*?" + NAMES + r"s?(?![A-Za-z])[A-Za-z0-9_.-]*+" + _OPERATOR + r"(?:(?i:bearer|basic|token)\s{1,3})?"
_QUOTED = "|".join(rf"{q}(?:[^{q}\\\r\n]++|\\.)++{q}" for q in "\"'`")
#: a comma, semicolon or angle belongs to a value that goes on after it, but not before a next name or a tag
_OPEN = r"(?:[^\s\"'`<>,;]++|[,;](?=[^\s\"'`<>,;])(?![A-Za-z_][A-Za-z0-9_.-]*+\s?[=:])|[<>](?=[^\s\"'`<>,;/A-Za-z!]))++"
ASSIGNED = r"(?<![_.-])(?=[A-Za-z0-9_.-]++" + _OPERATOR + ")" + NAMED + rf"(?:{_QUOTED}|[\"'`]?{_OPEN})"
TOKEN = r"(?<![_+/.-])(?=[A-Za-z0-9][A-Za-z0-9_+/.-]{15})(?=[A-Za-z_+/.-]*+[0-9]|(?:[^a-z\s]*+[a-z]++[A-Z]++){5})[A-Za-z0-9_+/.-]++={0,2}"
#: all but key blocks begin where no letter or digit goes before
PATTERN = f"{PEM}|(?<![A-Za-z0-9])(?:{ADDRESS}|{ASSIGNED}|{KNOWN}|{TOKEN})"
#: the words of sample values
WORDS = (
    "the and for with from this that have your here name user admin test demo sample example dummy fake place holder change "
    "default value string number text data file path home local host server client index main page image style script config "
    "version build release update class method object function return print import export module package library system "
    "service account email phone address street pass word secret token key api access private public none null true false "
    "enter insert replace todo foo bar baz abc xyz com org net http https www html json xml yaml log tmp var usr lib bin src "
    "article section chapter report paper study review figure table list item order customer product price total date time"
).split()
BENIGN = r"(?i)\b(?:commit|sha\d*|md5|hash|checksum|digest|uuid|guid|revision|rev|id|isbn|doi|serial|example|sample|placeholder|dummy|fixture|order|invoice|tracking|phone|call|fax|build|version|file|image|see)\b\W*(?:\w+\W+){0,1}$"
TELLING = f"(?:{NAMES}|(?i:login|key|signin|authorization|creds))\\W*(?:\\w+\\W+){{0,2}}$"


@lru_cache(4)
def dictionary(path: str, size: int = 3000) -> tuple[str, ...]:
    """The first so many whole words, of four letters or more, of a vocabulary file: its most frequent ones."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (w.removesuffix("</w>") for w in sorted(vocabulary, key=vocabulary.get) if w.endswith("</w>"))
    return tuple(islice((w for w in words if len(w) > 3 and w.isascii() and w.isalpha()), size))


def kind_of(match: Column) -> Column:
    return (
        F.when(match.startswith("-----BEGIN"), "private key")
        .when(match.rlike(f"^(?:{KNOWN})$"), "known format")
        .when(match.rlike(f"^(?:{ADDRESS})$"), "address")
        .when(match.rlike(f"^{NAMED}"), "assigned")
        .otherwise("token")
    )


def _given(match: Column) -> Column:
    """What is assigned, with its quotes."""
    return F.regexp_replace(match, f"^{NAMED}", "")


def value_of(match: Column) -> Column:
    """The secret itself: what is assigned, without quotes, or an address's password, or the whole candidate."""
    assigned = F.regexp_extract(_given(match), r"(?s)^([\"'`]?)(.*?)\1?$", 2)
    password = F.regexp_extract(match, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^:]*:(.*)@$", 1)
    kind = kind_of(match)
    return F.when(kind == "address", password).when(kind == "assigned", assigned).otherwise(match)


def end_of(match: Column, kind: Column) -> Column:
    """What of a candidate follows its value: an address's @, or a closing quote."""
    quote = F.regexp_extract(_given(match), r"(?s)^.+([\"'`])$", 1)
    return F.when(kind == "address", "@").when(kind == "assigned", quote).otherwise("")


def features(match: Column, value: Column, kind: Column, left: Column, right: Column, words: tuple[str, ...]) -> dict[str, Column]:
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(value, f"[^{pattern}]", "")) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "-")
    plain = F.regexp_replace(value, f"(?i){'|'.join(sorted(WORDS, key=len, reverse=True))}", "")
    runs = F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), F.lit(0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "length": n,
        "digits": share("0-9"),
        "upper": share("A-Z"),
        "lower": share("a-z"),
        "vowels": share("aeiouAEIOU"),
        "transitions": (F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "samples": 1 - F.length(plain) / n,
        "dictionary": F.aggregate(F.filter(runs, lambda r: F.lower(r).isin(*words)), F.lit(0), lambda a, r: a + F.length(r)) / n,
        "path": (n - F.length(F.regexp_replace(value, r"[/\\]|\.[a-z]{2,5}\b|://", ""))) / n + flag(left.rlike(r"(?:[/\\]|://\S*)$")),
        "separators": share("._-") + 0.0,
        "hex": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "uuid": flag(value.rlike(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")),
        "repeats": (n - F.length(F.regexp_replace(value, r"(.)\1{2,}", ""))) / n,
        "known": flag(kind.isin("known format", "private key")),
        "assigned": flag(kind == "assigned"),
        "firm": flag((kind == "assigned") & (match.rlike(f"^{NAMED}[\"'`]") | match.rlike(r"^[A-Za-z0-9_.-]+[\"'\]]{0,2}\s?=[^\s]"))),
        "code": (n - F.length(F.regexp_replace(value, r"[(){}\[\]<>$]|\.[a-z]+(?=[.(])", ""))) / n,
        "address": flag(kind == "address"),
        "telling": flag(left.rlike(TELLING)),
        "benign": flag(left.rlike(BENIGN)) + flag(right.rlike(r"(?i)^\W*(?:example|sample|placeholder|dummy)")),
    }


# ---------------------------------------------------------------- the forest


def labelled_findings(words: tuple[str, ...], n: int = 4000, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(left, match, right, 1 for a secret) of so many findings: keys of the usual formats, random values and
    people's passwords under telling names; and digests, identifiers, paths, sample values, code and words that
    look like them."""
    rng = random.Random(seed)
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    some = lambda chars, low, high=0: "".join(rng.choices(chars, k=rng.randint(low, high or low)))
    syllables = "ka lo mi tu se the er ing éa sch ung ción ou re st an".split()
    word = lambda: rng.choice(words) if rng.random() < 0.6 else "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    names = "password passwd pwd passphrase passcode secret token api_key apikey access_key private_key auth_token client_secret credentials auth".split()
    befores = ["", "", "", "db_", "DB_", "aws_secret_", "my", "user.", "app-", "x-", "smtp_", "client_", "root"]

    def name():
        own = rng.choice(befores) + rng.choice(names) + rng.choice(["", "", "", "", "s", "_1", "_value"])
        return rng.choice([own, own, own.upper(), own.title().replace("_", "")])

    def assigned(value, firm=0.5):
        """A value under a telling name, in quotes, right after the sign, or after a blank."""
        if rng.random() < firm:
            quote = rng.choice(["", '"', "'", '"'])
            return name() + rng.choice(["=", " = ", ": ", ":", '": ', " => ", " := "] if quote else ["="]) + quote + value + quote
        return name() + rng.choice([": ", " = ", " : ", ":"]) + value

    def human():
        """What people choose: words with figures or signs, or other letters."""
        a, b = rng.choice(words), rng.choice(words)
        sign, figures = rng.choice("!@#$%&*_-.,;+?"), some(string.digits, 1, 4)
        own = rng.choice([a + figures, a.title() + figures, a.title() + b.title() + figures, a + figures + b + figures, a + sign + b + figures, a.title() + sign + figures, a + b + sign, figures + a + sign, a.title() + figures + sign + b])
        if rng.random() < 0.3:
            own = own.translate(str.maketrans(rng.choice(["aeo", "eio", "ost"]), rng.choice(["430", "310", "057"])))
        return own

    def secret():
        kind = rng.random()
        if kind < 0.12:
            return "", rng.choice(["AKIA", "ASIA"]) + some(string.ascii_uppercase + string.digits, 16)
        if kind < 0.22:
            return "", rng.choice(["ghp_" + some(alnum, 36), "xoxb-" + some(string.digits, 12) + "-" + some(alnum, 24), "AIza" + some(alnum + "_-", 35), "sk_live_" + some(alnum, 24), f"eyJ{some(alnum, 30)}.eyJ{some(alnum, 60)}.{some(alnum + '_-', 43)}"])
        if kind < 0.42:
            return "", assigned(some(hexa, 8, 64))
        if kind < 0.58:
            return "", assigned(some(alnum + "!@#$%^&*+/_-", 7, 60))
        if kind < 0.66:
            return "", assigned(some(alnum, 16, 64) + rng.choice(["", "=", "=="]))
        if kind < 0.8:
            return "", assigned(human(), 0.8)
        if kind < 0.86:
            return rng.choice(["key ", "token ", "bearer token ", "login with ", "Authorization Bearer ", "secret key is "]), some(alnum + "+/", 24, 64) + rng.choice(["7", "A", "="])
        if kind < 0.96:
            return "", rng.choice(["postgres", "mysql", "https", "mongodb+srv", "redis", "amqp"]) + f"://{rng.choice([word(), 'root', ''])}:{rng.choice([some(alnum, 4, 40), human().replace('@', '').replace(',', ''), word() + some(alnum, 3, 9)])}@"
        return "", "-----BEGIN RSA PRIVATE KEY-----\n" + rng.choice(["", "Proc-Type: 4,ENCRYPTED\n"]) + some(alnum + "+/", 400) + "\n-----END RSA PRIVATE KEY-----"

    def sample():
        a, b = rng.choice(WORDS), rng.choice(["password", "token", "key", "secret", "here", "value", "test", "example"])
        return rng.choice(
            [f"your_{b}_here", f"your-{b}-here", f"<your-{b}>", "changeme", "changeme123", "x" * rng.randint(4, 20), "*" * rng.randint(4, 12), f"example_{b}_{rng.randint(1, 99)}", "placeholder", f"test_{b}", f"dummy_{a}",
             f"insert_{b}", "password123", "password", f"my_{b}", "TODO", "REPLACE_ME", f"fake-{b}-123", "secret123", "....", "foo", "bar"]
        )

    def code():
        a, b = rng.choice(words), rng.choice(WORDS)
        return rng.choice(["${DB_" + a.upper() + "}", "{{" + a + "_value}}", f"os.environ['{a.upper()}']", f"get{a.title()}()", f"{a}.{b}", f"self.{a}", f"config.{b}.{a}", f"request.{a}", f"$({a})", f"%{b}%", "null", "None", "true", "false", "undefined", "string", "required", "str", f"{a}_{b}", f"{a}({b})", f"process.env.{a.upper()}"])

    def other():
        kind = rng.random()
        if kind < 0.14:
            return rng.choice(["commit ", "sha256: ", "md5 ", "checksum ", "revision ", "see ", "digest sha1 ", "hash "]), some(hexa, rng.choice([32, 40, 64])) + rng.choice(["", "0"])
        if kind < 0.22:
            return rng.choice(["", "id ", "uuid: ", "session "]), "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))
        if kind < 0.36:
            return rng.choice(["", "example "]), assigned(sample())
        if kind < 0.5:
            return "", assigned(code(), 0.3)
        if kind < 0.64:  # prose, and counts
            return "", rng.choice(["token", "secret", "password", "auth", "tokens", "The password", "Secret", "max_tokens", "passwords"]) + rng.choice([": ", " : ", " = "]) + rng.choice([word(), word(), word() + ".", word().title(), str(rng.randint(1, 99999)), word() + "-" + word()])
        if kind < 0.76:
            return rng.choice(["", "/", "file ", "https://"]), "/".join(word() for _ in range(rng.randint(2, 5))) + rng.choice(["/2024/01/", "/v2/", "/p1/"]) + word() + rng.choice([".html", ".py", ".jpg", "", ".tar.gz"])
        if kind < 0.84:
            return rng.choice(["", "class ", "see "]), "".join(rng.choice(words).title() for _ in range(rng.randint(3, 7))) + rng.choice(["Handler", "Factory", "Test", "Example"]) + rng.choice(["", str(rng.randint(1, 99))])
        if kind < 0.9:
            return rng.choice(["", "call ", "card ", "order "]), some(string.digits, 16, 20)
        if kind < 0.96:
            return rng.choice(["", "build "]), "-".join([word(), word(), word(), str(rng.randint(1, 2030))]) + rng.choice(["-release", "-final", ".1.2", "-2024-01-02"])
        return "", rng.choice(["2024-01-02T03:04:05.678", "1.22.333-beta.4+build.5", "a" * 16 + "1", "abcdefghijklmnop123", "0123456789012345", "http://user:password@", "ftp://name:pass@", "https://username:your_password@"])

    out = []
    for i in range(n):
        is_secret = i % 2 == 0
        before, match = (secret if is_secret else other)()
        out.append((f"{text(rng.randint(0, 5))} {before}"[-40:], match, f" {text(rng.randint(0, 5))}"[:40], int(is_secret)))
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int = 3):
    """A tree of (feature, bound, left, right) and leaves' shares of ones, by the Gini index."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    best = (np.inf, 0, 0.0)
    for f in rng.choice(x.shape[1], min(x.shape[1], 11), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        k = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (k >= least) & (len(y) - k >= least)
        if not ok.any():
            continue
        a, b = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(y) - k)
        gini = np.where(ok, k * a * (1 - a) + (len(y) - k) * b * (1 - b), np.inf)
        i = int(gini.argmin())
        if gini[i] < best[0]:
            best = (gini[i], int(f), float((v[i] + v[i + 1]) / 2))
    if best[0] == np.inf:
        return float((y.sum() + 0.5) / (len(y) + 1))
    _, f, bound = best
    low = x[:, f] <= bound
    return (f, bound, grow(x[low], y[low], rng, depth - 1, least), grow(x[~low], y[~low], rng, depth - 1, least))


def forest_of(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 8, seed: int = 11) -> list:
    out = []
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        rows = rng.integers(0, len(y), len(y))
        out.append(grow(x[rows], y[rows], rng, depth))
    return out


def probability(forest: list, columns: list[Column]) -> Column:
    """The mean of the trees' leaves, as an expression."""

    def of(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        f, bound, low, high = node
        return F.when(columns[f] <= bound, of(low)).otherwise(of(high))

    total = of(forest[0])
    for tree in forest[1:]:
        total = total + of(tree)
    return total / len(forest)


_FORESTS: dict = {}


def trained(spark: SparkSession, n: int = 4000, seed: int = 5, vocabulary: str | None = None) -> tuple[list, tuple[str, ...]]:
    """The forest of labelled_findings() of so many, and the dictionary of its features, which scans compute too."""
    path = vocabulary or tokenizer_path(VOCABULARY)
    if (n, seed, path) not in _FORESTS:
        words = dictionary(path)
        rows = spark.createDataFrame(labelled_findings(words, n, seed), "left string, match string, right string, y int")
        rows = rows.select("left", "match", "right", "y", value_of(F.col("match")).alias("value"), kind_of(F.col("match")).alias("kind"))
        columns = features(*(F.col(c) for c in ("match", "value", "kind", "left", "right")), words)
        table_ = np.array([tuple(r) for r in rows.select(*(c.alias(k) for k, c in columns.items()), "y").collect()], float)
        _FORESTS[n, seed, path] = forest_of(table_[:, :-1], table_[:, -1]), words
    return _FORESTS[n, seed, path]


# ---------------------------------------------------------------- scans


def scanned(docs: DataFrame, model: tuple[list, tuple[str, ...]], threshold: float = 0.3) -> DataFrame:
    """Adds __found, each candidate with the text since the one before (gap), its kind, value, end, probability
    and whether it is a secret; and __tail, the text after the last. Null texts have none."""
    text, (forest, words) = F.col("text"), model
    docs = docs.withColumn("__matches", F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>")))
    gaps = F.when(F.size("__matches") > 0, F.split(text, PATTERN, -1)).otherwise(F.array(F.coalesce(text, F.lit(""))))
    docs = docs.withColumn("__gaps", gaps)
    # beside each match the texts around it: a lambda that looked into __gaps would split the text again for each
    n = F.size("__matches")
    beside = F.arrays_zip(F.col("__matches").alias("match"), F.slice("__gaps", F.lit(1), n).alias("gap"), F.slice("__gaps", F.lit(2), n).alias("then"))
    first = F.transform(
        beside,
        lambda m: F.struct(
            m.gap.alias("gap"), m.match.alias("match"), value_of(m.match).alias("value"), kind_of(m.match).alias("kind"),
            F.substring(m.gap, -40, 40).alias("left"), F.substring(m.then, 1, 40).alias("right"),
        ),
    )
    same = lambda c: (c.gap.alias("gap"), c.match.alias("match"), c.value.alias("value"), c.kind.alias("kind"))
    known = lambda c: F.struct(*(x.alias(k) for k, x in features(c.match, c.value, c.kind, c.left, c.right, words).items())).alias("f")
    second = F.transform("__first", lambda c: F.struct(*same(c), end_of(c.match, c.kind).alias("end"), known(c)))
    names = list(features(*(F.lit("") for _ in range(5)), words))
    third = F.transform("__second", lambda c: F.struct(*same(c), c.end.alias("end"), probability(forest, [c.f[k] for k in names]).alias("probability")))
    docs = docs.withColumn("__first", first).withColumn("__second", second).withColumn("__found", third)
    found = F.transform("__found", lambda c: c.withField("secret", (c.probability >= threshold) & (c.value != "")))
    return docs.withColumn("__found", found).withColumn("__tail", F.element_at("__gaps", -1)).drop("__matches", "__gaps", "__first", "__second")


def findings(docs: DataFrame, model: tuple | None = None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, text) -> doc_id, start, length, kind, value_sha256, probability: every secret in every row,
    with its place in code points. The threshold is under a half, for a secret that is missed costs more than a
    sample value that is hidden. Null and empty texts have none; repeated rows have the same ones again."""
    docs = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "text")
    docs = scanned(docs, model or trained(docs.sparkSession), threshold)
    # outer: from a plain one Spark infers a filter on __found's size, and computes it twice for that
    each = docs.select("__row", "doc_id", F.posexplode_outer("__found").alias("i", "c"))
    each = each.select("__row", "i", "doc_id", F.length("c.gap").alias("gap"), F.length("c.match").alias("n"), F.length("c.value").alias("length"), "c.kind", F.sha2(F.col("c.value").cast("binary"), 256).alias("value_sha256"), "c.probability", "c.secret", F.length("c.end").alias("end"))
    before = F.expr("sum(gap + n) over (partition by __row order by i rows between unbounded preceding and current row)")
    placed = each.withColumn("start", before - F.col("length") - F.col("end")).where("secret")
    return placed.select("doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "kind", "value_sha256", F.round("probability", 6).alias("probability"))


def redacted(docs: DataFrame, model: tuple | None = None, threshold: float = 0.3, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret's value replaced by mark in text; n_chars follows where it is there."""
    columns = docs.columns
    docs = scanned(docs, model or trained(docs.sparkSession), threshold)
    name = lambda c: F.substring(c.match, F.lit(1), F.length(c.match) - F.length(c.value) - F.length(c.end))
    piece = lambda c: F.concat(c.gap, F.when(c.secret, F.concat(name(c), F.lit(mark), c.end)).otherwise(c.match))
    whole = F.concat(F.array_join(F.transform("__found", piece), ""), F.col("__tail"))
    docs = docs.withColumn("__clean", F.when(F.exists("__found", lambda c: c.secret), whole).otherwise(F.col("text")))
    out = {"text": F.col("__clean")}
    if "n_chars" in columns:
        changed = F.col("__clean") != F.col("text")
        out["n_chars"] = F.when(changed, F.length("__clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return docs.select(*(out[c].alias(c) if c in out else F.col(f"`{c}`") for c in columns))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"))
