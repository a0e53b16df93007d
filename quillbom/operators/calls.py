"""Calls of cryptography in JavaScript and TypeScript files.

The tokens of each file become rows of four kinds: calls, bindings of names to modules, numbers
under telling names, and comments. What they mean is said by joins and expressions: names
are resolved to modules by a join within the file, where a binding counts for the calls after it,
and rules turn resolved calls into findings.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbom.functions import columns as C
from quillbom.functions.keys import scan_key
from quillbom.operators import lexer, scan

# Names that stand for a module without any binding.
SEEDS = {"crypto": "crypto", "node:crypto": "crypto", "subtle": "subtle", "cryptojs": "cryptojs", "crypto_js": "cryptojs", "jwt": "jwt", "jsonwebtoken": "jwt", "jose": "jwt"}
# What modules are taken for.
MODULES = {"crypto": "crypto", "node:crypto": "crypto", "crypto-js": "cryptojs", "jsonwebtoken": "jwt", "jose": "jwt", "bcrypt": "bcrypt", "bcryptjs": "bcrypt", "bcrypt-nodejs": "bcrypt"}
NUMBER_NAMES = r"alg|algorithm|coseAlg|coseAlgorithm|preferredAlgorithm"

_OPENS, _CLOSES = frozenset("([{"), {")": "(", "]": "[", "}": "{"}


def facts(code: str) -> list[tuple]:
    """(kind, pos, line, a, b, args): calls (receiver, method, arguments as they stand), bindings (name, module
    or name it comes from, and in args what it is called there), numbers (name, value), comments (text)."""
    feeds, out, found = [m.start() for m in re.finditer("\n", code)], [], []
    line = lambda at: bisect_left(feeds, at) + 1
    for kind, value, at in lexer.tokens(code):
        if kind == "comment":
            first = line(at)
            out += [("comment", at, first + i, t, None, None) for i, t in enumerate(value.split("\n"))]
        else:
            found.append((kind, value, at))
    found = lexer.paths(found)
    what = lambda i: found[i][1] if 0 <= i < len(found) and found[i][0] == "mark" else ""
    kind_of = lambda i: found[i][0] if 0 <= i < len(found) else ""
    open_brackets: list[tuple[str, int | None, list[int]]] = []  # opener, place of the call's name, places of commas

    def closed(name_at: int, cuts: list[int], end: int) -> None:
        _, value, at = found[name_at]
        if what(end) == ")" and what(end + 1) == "{":  # a method's definition
            return
        args = ["".join(t[1] for t in found[a + 1:b]) for a, b in zip([name_at + 1, *cuts], [*cuts, end], strict=True)]
        args = args if args != [""] else []
        head, _, method = value.rpartition(".")
        out.append(("call", at, line(at), head, method, args))
        if value in ("require", "import") and args:
            out.extend(_bound(found, name_at - (found[name_at - 1][1] == "await" and name_at > 0), args[0].strip("'\"`"), at, line(at)))

    for i, (kind, value, at) in enumerate(found):
        if kind == "mark" and value in _OPENS:
            named = value == "(" and kind_of(i - 1) == "name" and found[i - 1][1] not in lexer.NO_CALLS and not (kind_of(i - 2) == "name" and found[i - 2][1] == "function")
            open_brackets.append((value, i - 1 if named else None, []))
        elif kind == "mark" and value in _CLOSES and any(b[0] == _CLOSES[value] for b in open_brackets[-2:]):
            while True:
                opener, name_at, cuts = open_brackets.pop()
                if name_at is not None:
                    closed(name_at, cuts, i)
                if opener == _CLOSES[value]:
                    break
        elif kind == "mark" and value == "," and open_brackets:
            open_brackets[-1][2].append(i)
        elif kind == "name":
            after, then = what(i + 1), kind_of(i + 2)
            if after in ("=", ":") and then == "number" and re.fullmatch(NUMBER_NAMES, value.rpartition(".")[2]):
                out.append(("number", at, line(at), value, found[i + 2][1], None))
            elif after == "=" and then == "name" and "." not in value and what(i + 3) != "(" and found[i + 2][1] not in lexer.NO_CALLS:
                out.append(("binding", at, line(at), value, found[i + 2][1], None))
            elif value == "from" and kind_of(i + 1) == "text":
                out += _imported(found, i, found[i + 1][1][1:-1], at, line(at))
    while open_brackets:  # code that ends before its brackets do
        _, name_at, cuts = open_brackets.pop()
        if name_at is not None:
            closed(name_at, cuts, len(found))
    return out


def _names(found: list[tuple], i: int, stop: str) -> Iterator[tuple[str, str]]:
    """(name, what it is called in the module) backwards from a place to a word or bracket, as in `a, b: c` and `a, b as c`."""
    while i >= 0 and found[i][1] != stop and found[i][1] not in (";", "=", "("):
        if found[i][0] == "name" and found[i][1] not in ("as", "type"):
            renamed = i > 1 and found[i - 1][1] in (":", "as") and found[i - 2][0] == "name"
            yield found[i][1], found[i - 2 if renamed else i][1]
            i -= 2 * renamed
        i -= 1


def _imported(found: list[tuple], i: int, module: str, at: int, line: int) -> list[tuple]:
    """Names that `import x, {a as b} from m` binds."""
    return [("binding", at, line, name, module, [known]) for name, known in _names(found, i - 1, "import")]


def _bound(found: list[tuple], i: int, module: str, at: int, line: int) -> list[tuple]:
    """Names that `x = require(m)` and `{a, b: c} = require(m)` bind."""
    if i < 2 or found[i - 1][1] != "=":
        return []
    if found[i - 2][0] == "name":
        return [("binding", at, line, found[i - 2][1], module, None)]
    return [("binding", at, line, name, module, [known]) for name, known in _names(found, i - 3, "{")] if found[i - 2][1] == "}" else []


def code_facts(files: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The rows of facts() for each file ((scan,) path, content), of all kinds or of those only."""
    by = scan_key(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, found = [*by, "path", "kind", "pos", "line", "a", "b", "args"], []
        for rows in batches:
            for *file, text in zip(*(rows[c] for c in [*by, "path"]), rows["text"], strict=True):
                found += [(*file, *f) for f in facts(text or "") if not kinds or f[0] in kinds]
                if len(found) > 10_000:
                    yield pd.DataFrame(found, columns=columns)
                    found = []
        if found:
            yield pd.DataFrame(found, columns=columns)

    kind = "".join(f"{c} {files.schema[c].dataType.simpleString()}, " for c in by)
    return files.select(*by, "path", C.as_text(F.col("content")).alias("text")).mapInPandas(run, f"{kind}path string, kind string, pos long, line long, a string, b string, args array<string>")


def resolved_calls(rows: DataFrame) -> DataFrame:
    """Calls with the module their receiver stands for: by a binding before them in the file, or by the name alone."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    by = scan_key(rows)
    is_call = F.col("kind") == "call"
    origin = F.coalesce(F.try_element_at(table(MODULES), F.lower("b")), F.try_element_at(table(SEEDS), F.lower(F.substring_index("b", ".", -1))))
    binding = F.when(~is_call & origin.isNotNull(), F.struct(F.col("pos").alias("since"), origin.alias("module"), F.get("args", F.lit(0)).alias("called")))
    head = F.lower(F.when(is_call, F.substring_index(F.when(F.col("a") == "", F.col("b")).otherwise(F.col("a")), ".", 1)).otherwise(F.col("a")))
    # calls and bindings of a name meet in a window, so that files are lexed once for both
    rows = rows.where("kind in ('call', 'binding')").withColumns({"head": head, "bound": binding}).where(is_call | F.col("bound").isNotNull())
    first = F.min("bound").over(Window.partitionBy(*by, "path", "head"))
    calls = rows.withColumn("m", first).where(is_call).select(*by, "path", "pos", "line", F.col("a").alias("receiver"), F.col("b").alias("method"), "args", "head", "m.*")
    named = F.try_element_at(table(SEEDS), F.col("head"))
    low = F.lower("receiver")
    own = F.when(F.col("since") < F.col("pos"), F.col("module"))
    known = (
        F.when(F.lower(F.substring_index("receiver", ".", -1)) == "subtle", "subtle")
        .when(F.contains(low, F.lit("bcrypt")), "bcrypt")
        .otherwise(F.coalesce(own, F.when(F.col("receiver") != "", named), F.when(low.rlike("jwt|jose"), "jwt")))
    )
    method = F.when((F.col("receiver") == "") & own.isNotNull(), F.coalesce("called", "method")).otherwise(F.col("method"))  # what a name stands for in its module
    return calls.withColumns({"module": known, "method": method}).where("module is not null").drop("since", "head", "called")


def literal(args: Column, place: int) -> Column:
    """A literal argument's text; null where it is none."""
    arg = F.get(args, F.lit(place))
    return F.when(arg.rlike("^[\"'`][^$]*[\"'`]\\z"), F.substr(arg, F.lit(2), F.length(arg) - 2)).when(arg.rlike(r"^-?\d+\z"), arg)


def findings(files: DataFrame) -> DataFrame:
    """Findings of calls and COSE numbers, with direct evidence."""
    calls = call_findings(resolved_calls(code_facts(files, ("call", "binding"))))
    named = files.where(F.contains(C.as_text(F.col("content")), F.lit("lg")))  # no other file has a name of NUMBER_NAMES
    return calls.unionByName(number_findings(code_facts(named, ("number",))))


def number_findings(rows: DataFrame) -> DataFrame:
    numbers = rows.where("kind = 'number'").withColumn("cose", scan.cose_column(F.col("b").try_cast("int"))).where("cose is not null").dropDuplicates([*scan_key(rows), "path", "line", "b"]).withColumn("filePath", F.col("path"))
    return scan.finding(numbers, "ast", "direct", assetType="algorithm", name=F.col("cose.family"), algorithmFamily=F.col("cose.family"), primitive="signature", parameterSet=F.col("cose.parameter"), rawConfidence=0.95, detail=F.concat(F.lit("COSE number "), F.col("b")))


# What the names of web algorithms begin with, and their family.
WEB_FAMILIES = [
    ("RSASSA-PKCS1", "RSA"), ("RSA-OAEP", "RSA"), ("RSA-PSS", "RSA-PSS"), ("ECDSA", "ECDSA"), ("ECDH", "ECDH"), ("AES", "AES"), ("HMAC", "HMAC"), ("PBKDF2", "PBKDF2"), ("HKDF", "HKDF"), ("ED25519", "EdDSA"),
]


def web_algorithm(arg: Column) -> Column:
    """struct(family, parameter) of a web algorithm: a name, or an object with curve, hash and lengths; null for what is neither."""
    text = F.trim(arg)
    value = lambda t, name: F.nullif(F.regexp_extract(t, rf"(?<![A-Za-z]){name}[\"']?\s*:\s*[\"'`]?([\w.+-]+)", 1), F.lit(""))
    nested = F.nullif(F.regexp_extract(text, r"(?<![A-Za-z])hash[\"']?\s*:\s*\{[^}]*?name[\"']?\s*:\s*[\"'`]([^\"'`]+)", 1), F.lit(""))
    outer = F.regexp_replace(text, r"hash[\"']?\s*:\s*\{[^}]*\}", "")
    named = F.upper(F.coalesce(value(outer, "name"), F.lit("UNKNOWN")))
    family = named
    for start, known in reversed(WEB_FAMILIES):
        family = F.when(F.startswith(named, F.lit(start)), known).otherwise(family)
    bits = lambda name: F.concat(value(outer, name), F.lit(" bits"))
    parts = F.concat_ws(" / ", value(outer, "namedCurve"), F.upper(F.coalesce(nested, value(outer, "hash"))), bits("length"), bits("modulusLength"))
    word = F.regexp_extract(text, r"^[\"'`](.*)[\"'`]\z", 1)
    plain = C.algorithm_identifier(word)
    return F.when(F.startswith(text, F.lit("{")), F.struct(family.alias("family"), F.nullif(parts, F.lit("")).alias("parameter"))).when(
        word != "", F.struct(F.coalesce(plain["family"], F.upper(word)).alias("family"), plain["key_size"].alias("parameter"))
    )


def token_algorithms(args: Column) -> Column:
    """The algorithms that a token's options name, one or a list; HS256 where they name none."""
    joined = F.array_join(args, ",")
    one = F.regexp_extract_all(joined, F.lit(r"algorithm[\"']?\s*:\s*[\"'`]([^\"'`]+)"), 1)
    lists = F.array_join(F.regexp_extract_all(joined, F.lit(r"algorithms[\"']?\s*:\s*\[([^\]]*)\]"), 1), ",")
    several = F.regexp_extract_all(lists, F.lit(r"[\"'`]([^\"'`]+)[\"'`]"), 1)
    found = F.concat(one, several)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("HS256")))


def call_findings(calls: DataFrame) -> DataFrame:
    """Rules by module and method; the first that fits decides, calls without one give nothing. A token call gives a finding for each algorithm it names."""
    calls = calls.withColumns({"arg": literal(F.col("args"), 0), "filePath": F.col("path")}).withColumn("known", C.algorithm_identifier(F.col("arg")))
    calls = calls.withColumns({"web": web_algorithm(F.get("args", F.lit(0))), "imported": web_algorithm(F.get("args", F.lit(2)))})
    calls = calls.withColumn("alg", F.explode_outer(F.when(F.col("module") == "jwt", token_algorithms(F.col("args")))))
    m, on = F.col("method"), lambda module, *names: (F.col("module") == module) & F.col("method").isin(*[x for n in names for x in (n, f"{n}Sync")])
    family, sure = F.col("known.family"), F.when(F.col("arg").isNotNull(), 0.95)
    text = F.lit(None).cast("string")
    say = lambda fam, primitive, parameter=text, mode=text, material=text, confidence=F.lit(0.95): F.struct(
        (fam if isinstance(fam, Column) else F.lit(fam)).alias("family"), (primitive if isinstance(primitive, Column) else F.lit(primitive).cast("string")).alias("primitive"), parameter.alias("parameter"),
        mode.alias("mode"), (material if isinstance(material, Column) else F.lit(material)).alias("material"), confidence.alias("confidence"),
    )
    maybe = lambda x: F.coalesce(sure, F.lit(x))
    cipher = F.coalesce(family, F.lit("AES"))
    stream = F.when(F.upper(cipher).isin("RC4", "CHACHA20"), "stream-cipher").otherwise("block-cipher")
    web = F.coalesce(F.col("web.family"), F.lit("ECDSA"))
    curve = F.when(F.col("web").isNull(), "P-256").otherwise(F.col("web.parameter"))
    key = F.coalesce(F.col("imported.family"), F.lit("ECDSA"))
    key_curve = F.when(F.col("imported").isNull(), "P-256").otherwise(F.col("imported.parameter"))
    pair = F.upper(key).isin("ECDSA", "ECDH", "RSA", "RSA-PSS", "EDDSA")
    last = F.substring_index("receiver", ".", -1)
    kind = lambda word: F.lower(last).contains(word)
    js = F.when(kind("tripledes"), "3DES").when(kind("des"), "DES").when(kind("rc4"), "RC4").when(kind("rabbit"), "Rabbit").otherwise("AES")
    either = lambda pattern: F.when(m.rlike(pattern), m).when(last.rlike(pattern), last)  # noqa: E731  # the method's name, or what it is a method of
    digest, mac, derived = either(r"(?i)^(sha(256|512|384|224|1|3)|md5|ripemd160)\z"), either("(?i)^hmac"), either(r"(?i)^(pbkdf2|evpkdf)\z")
    alg = F.col("alg")
    token = C.algorithm_identifier(alg)
    no_token = F.lower(alg) == "none"
    third, fourth = literal(F.col("args"), 3), literal(F.col("args"), 4)
    secret = literal(F.col("args"), 1)
    weak = secret.isNotNull() & (secret != "") & ((F.length(secret) < 16) | (secret == "secret"))
    hit = (
        F.when(on("subtle", "sign", "verify"), say(web, F.when(web == "HMAC", "mac").otherwise("signature"), curve))
        .when(on("subtle", "digest"), say(F.coalesce(F.col("web.family"), F.lit("SHA-256")), "hash", F.col("web.parameter")))
        .when(on("subtle", "importKey"), say(key, F.when(pair, text).otherwise("block-cipher"), key_curve, material=F.when(pair, F.when(F.col("arg") == "pkcs8", "private-key").otherwise("public-key"))))
        .when(on("subtle", "generateKey"), say(web, "signature", curve))
        .when(on("subtle", "deriveKey", "deriveBits"), say(F.coalesce(F.col("web.family"), F.lit("HKDF")), F.when(F.col("web.family") == "ECDH", "key-agree").otherwise("kdf"), F.col("web.parameter")))
        .when(F.col("module") == "subtle", F.lit(None))
        .when(on("crypto", "verify", "sign"), say(F.coalesce(family, F.lit("RSA")), "signature", F.coalesce("known.mode", "arg"), confidence=maybe(0.85)))
        .when(on("crypto", "createPublicKey"), say("RSA", None, material="public-key", confidence=F.lit(0.90)))
        .when(on("crypto", "createPrivateKey"), say("RSA", None, material="private-key", confidence=F.lit(0.90)))
        .when(m == "timingSafeEqual", say("timingSafeEqual", None))
        .when(on("crypto", "hkdf"), say("HKDF", "kdf", F.coalesce("arg", F.lit("sha256")), confidence=maybe(0.85)))
        .when(on("crypto", "createHash"), say(F.coalesce(family, F.lit("SHA-256")), "hash", confidence=maybe(0.80)))
        .when(on("crypto", "createHmac"), say("HMAC", "mac", mode=F.coalesce("known.mode", F.upper("arg")), confidence=maybe(0.80)))
        .when(on("crypto", "createCipher", "createCipheriv", "createDecipher", "createDecipheriv"), say(cipher, stream, F.col("known.key_size"), F.coalesce(F.col("known.mode"), F.when(family.isNull(), "CBC")), confidence=maybe(0.80)))
        .when(on("crypto", "createSign", "createVerify"), say(F.coalesce(family, F.lit("RSA")), "signature", mode=F.coalesce("known.mode", F.upper("arg")), confidence=maybe(0.80)))
        .when(on("crypto", "pbkdf2"), say("PBKDF2", "kdf", F.concat_ws(", ", F.concat(literal(F.col("args"), 2), F.lit(" iters")), F.concat(third, F.lit(" bytes")), F.coalesce(fourth, third)), confidence=F.when(literal(F.col("args"), 2).isNotNull() | third.isNotNull() | fourth.isNotNull(), 0.95).otherwise(0.85)))
        .when(on("crypto", "scrypt"), say("scrypt", "kdf"))
        .when(on("crypto", "randomBytes"), say("CSPRNG", "drbg", F.concat((F.col("arg").try_cast("int") * 8).cast("string"), F.lit(" bits")), confidence=maybe(0.85)))
        .when(on("crypto", "generateKeyPair"), say(F.coalesce(F.upper("arg"), F.lit("RSA")), None, material="private-key", confidence=maybe(0.80)))
        .when(on("crypto", "createDiffieHellman"), say("DH", "key-agree", F.col("arg"), confidence=maybe(0.80)))
        .when(on("crypto", "createECDH"), say("ECDH", "key-agree", F.col("arg"), confidence=maybe(0.80)))
        .when(on("bcrypt", "genSalt"), say("bcrypt", None, F.concat(F.col("arg"), F.lit(" rounds")), material="salt", confidence=maybe(0.85)))
        .when(on("bcrypt", "compare"), say("bcrypt", None))
        .when(on("bcrypt", "hash"), say("bcrypt", "kdf"))
        .when((F.col("module") == "jwt") & F.lower(m).isin("sign", "verify", "signjwt", "jwtverify", "compactsign", "compactencrypt"), say(F.when(no_token, "none").otherwise(token["family"]), "signature", F.when(no_token, "none-algorithm-insecure").when(weak, "weak-secret").otherwise(alg), F.when(~no_token, token["mode"]), confidence=F.when(F.contains(F.array_join("args", ","), F.lit("algorithm")), 0.95).otherwise(0.80)))
        .when(on("cryptojs", "encrypt", "decrypt", "createEncryptor", "createDecryptor"), say(js, F.when(js.isin("RC4", "Rabbit"), "stream-cipher").otherwise("block-cipher")))
        .when((F.col("module") == "cryptojs") & digest.isNotNull(), say(C.algorithm_identifier(digest)["family"], "hash"))
        .when((F.col("module") == "cryptojs") & mac.isNotNull(), say("HMAC", "mac", mode=F.coalesce(F.nullif(F.upper(F.substring(mac, 5, 99)), F.lit("")), F.lit("SHA-256"))))
        .when((F.col("module") == "cryptojs") & derived.isNotNull(), say(F.upper(derived), "kdf"))
    )
    hits = calls.withColumn("hit", hit).where("hit is not null")
    stored = F.col("hit.material").isNotNull()
    name = F.when(F.col("hit.material") == "salt", "bcrypt-salt").when(stored & (F.col("hit.confidence") == 0.90), F.col("hit.material")).otherwise(F.col("hit.family"))
    return scan.finding(
        hits, "ast", "direct", assetType=F.when(stored, "related-crypto-material").otherwise("algorithm"), name=name, algorithmFamily=F.col("hit.family"), primitive=F.col("hit.primitive"),
        parameterSet=F.nullif(F.col("hit.parameter"), F.lit("")), mode=F.col("hit.mode"), materialType=F.col("hit.material"), rawConfidence=F.col("hit.confidence"), detail=F.concat_ws(".", F.nullif("receiver", F.lit("")), "method"),
    )


# What commented-out code is taken for: pattern, family, primitive, parameter, material; of the
# patterns of one topic the first that fits decides.
COMMENT_RULES = [
    ("bcrypt", r"bcrypt\w*\.genSalt(?:Sync)?\(", "bcrypt", None, None, "salt"),
    ("bcrypt", r"bcrypt\w*\.compare(?:Sync)?\(", "bcrypt", None, None, None),
    ("bcrypt", r"bcrypt\w*\.hash(?:Sync)?\(", "bcrypt", "kdf", None, None),
    ("pbkdf2", r"pbkdf2(?:Sync)?\(", "PBKDF2", "kdf", "sha512", None),
    ("cipher", r"createCipher(?:iv)?\(", "AES", "block-cipher", None, None),
    ("decipher", r"createDecipher(?:iv)?\(", "AES", "block-cipher", None, None),
    ("random", r"randomBytes(?:Sync)?\(", "CSPRNG", "drbg", "128 bits", None),
    ("jwt", r"(?:jwt|jsonwebtoken)\.(?:sign|verify)\(", "HMAC", "signature", "HS256", None),
]


def comment_hits(rows: DataFrame, text: str) -> DataFrame:
    """rows with the comment rules that fire on a text, one for each topic at most."""
    topics: dict[str, Column] = {}
    for i, (topic, pattern, family, primitive, parameter, material) in reversed(list(enumerate(COMMENT_RULES))):
        s = lambda v: F.lit(v).cast("string")
        hit = F.struct(F.lit(i).alias("rule"), s(family).alias("family"), s(primitive).alias("primitive"), s(parameter).alias("parameter"), s(material).alias("material"))
        topics[topic] = F.when(F.col(text).rlike(pattern), hit).otherwise(topics[topic]) if topic in topics else F.when(F.col(text).rlike(pattern), hit)
    return rows.withColumn("hit", F.explode(F.array_compact(F.array(*topics.values()))))


def comment_findings(rows: DataFrame) -> DataFrame:
    """Findings in comments, less sure than live code and marked as such."""
    hits = comment_hits(rows.where("kind = 'comment'"), "a").withColumn("filePath", F.col("path"))
    stored = F.col("hit.material").isNotNull()
    return scan.finding(
        hits, "ast", "direct", assetType=F.when(stored, "related-crypto-material").otherwise("algorithm"), name=F.col("hit.family"), algorithmFamily=F.col("hit.family"), primitive=F.col("hit.primitive"),
        parameterSet=F.col("hit.parameter"), materialType=F.col("hit.material"), rawConfidence=0.65, sourceContext="comment", detail=F.substring(F.trim("a"), 1, 60),
    )
