"""Rules one by one, and the whole chain against RE2.

Values that look like secrets are put together here, so that none is stored.
"""

import random

import duckdb
import pytest

import oracle
from shelltrail.functions.rules import RULES, Rule, java_pattern
from shelltrail.operators import redact as r

HEX, ALNUM, UPPER = "0a1b2c3d", "aB3dE6gH", "AB1CD2EF"


def fill(alphabet, n):
    return (alphabet * (n // len(alphabet) + 1))[:n]


R = "<REDACTED>"
KEY = "KEY"

# rule, text it changes, result of the whole chain, text it leaves alone
CASES = [
    ("password-flag-quoted-double", 'db --password "two words" x', f'db --password "{R}" x', "db --password"),
    ("password-flag-quoted-single", "db --password='two words' x", f"db --password='{R}' x", "db --passwor='a'"),
    ("password-flag-unquoted", "db --password=abc x", f"db --password={R} x", "db --passwordabc"),
    ("passwd-flag", "db --passwd 'abc'", f"db --passwd '{R}'", "db --passwd"),
    ("mysql-password", "mysql -uroot -pabc db", f"mysql -uroot -p{R} db", "mysql -p db"),
    ("token-flag", "cli --token abc", f"cli --token {R}", "cli --tokens"),
    ("api-key-flag", "cli --api-key 'abc'", f"cli --api-key '{R}'", "cli --api-keys"),
    ("secret-flag", "cli --secret=abc", f"cli --secret={R}", "cli --secrets"),
    ("api-key-export", "export MY_APIKEY=abc", f"export MY_APIKEY={R}", "export MY_API=abc"),
    ("secret-export", "export A_SECRET_B=abc", f"export A_SECRET_B={R}", "export a_secret=abc"),
    ("password-export", "export DB_PASS=abc", f"export DB_PASS={R}", "export DB_PAS=abc"),
    ("token-export", "export A_TOKEN='abc'", f"export A_TOKEN='{R}'", "export A_TOKENS=abc"),
    ("credentials-export", "export CREDS=abc", f"export CREDS={R}", "export CRE=abc"),
    ("aws-access-key-id", "AWS_ACCESS_" + KEY + "_ID=" + fill(UPPER, 20), f"AWS_ACCESS_{KEY}_ID={R}", "AWS_ACCESS_" + KEY + "_ID=" + fill(UPPER, 19)),
    ("aws-secret-key", "AWS_SECRET_ACCESS_" + KEY + "=" + fill(ALNUM, 40), f"AWS_SECRET_ACCESS_{KEY}={R}", "AWS_SECRET_ACCESS_" + KEY + "= x"),
    ("aws-session-token", "AWS_SESSION_TOKEN=abc", f"AWS_SESSION_TOKEN={R}", "AWS_SESSION=abc"),
    ("connection-string-password", "psql pg://me:pw@host/db", f"psql pg://me:{R}@host/db", "curl http://host:80/x"),
    ("bearer-token", "h Authorization: Bearer abc", f"h Authorization: Bearer {R}", "h Authorization: Other abc"),
    ("basic-auth", "h Authorization:Basic abc", f"h Authorization:Basic {R}", "h Authorization: Basicabc"),
    ("github-token", "x gh" + "p_" + fill(ALNUM, 36), f"x {R}", "x gh" + "p_" + fill(ALNUM, 35)),
    ("github-pat", "x github_" + "pat_" + fill(ALNUM, 22), f"x {R}", "x github_" + "pat_" + fill(ALNUM, 21)),
    ("jwt-token", "x e" + "yJhbG.e" + "yJzdW.c2ln y", "x <REDACTED_JWT> y", "x ye" + "yJhbG.e" + "yJzdW.c2ln"),
    ("slack-bot-token", "x xox" + "b-12-34-ab", f"x {R}", "x xox" + "b-12-ab"),
    ("slack-user-token", "x xox" + "p-1-2-3-ab", f"x {R}", "x xox" + "p-1-2-ab"),
    ("slack-app-token", "x xap" + "p-1-A-2-b", f"x {R}", "x xap" + "p-1-A-b"),
    ("slack-refresh-token", "x xox" + "r-1-ab", f"x {R}", "x xox" + "r-ab"),
    ("slack-webhook", "x https://hooks.slack" + ".com/services/T1/B2/c3", "x <REDACTED_SLACK_WEBHOOK>", "x https://hooks.slack" + ".com/services/t1/B2/c3"),
    ("discord-webhook", "x https://discordapp" + ".com/api/webhooks/12/ab-c", "x <REDACTED_DISCORD_WEBHOOK>", "x https://discordapp" + ".com/api/webhooks/ab/c"),
    ("generic-webhook-secret", "x https://h.org/webhook/" + fill(ALNUM, 20), f"x https://h.org/webhook/{R}", "x https://h.org/webhook/" + fill(ALNUM, 19)),
    ("gcp-api-key", "x AI" + "za" + fill(ALNUM, 35), f"x {R}", "x AI" + "za" + fill(ALNUM, 34)),
    ("google-oauth", "x ya" + "29.abc-d", f"x {R}", "x ya" + "29abc"),
    ("azure-storage-key", "x accountkey = " + fill(ALNUM, 88), f"x accountkey = {R}", "x accountkey = " + fill(ALNUM, 87)),
    ("azure-connection-string", "defaultEndpointsProtocol=https;AccountName=n;AccountKey=" + fill(ALNUM, 9), f"defaultEndpointsProtocol=https;AccountName=n;AccountKey={R}", "DefaultEndpointsProtocol=ftp;AccountName=n;AccountKey=a"),
    ("azure-sas-token", "x h?sv=1&sig=ab", f"x h?sv={R}&sig={R}", "x h?sx=1"),
    ("digitalocean-token", "x dop" + "_v1_" + fill(HEX, 64), f"x {R}", "x dop" + "_v1_" + fill(HEX, 63)),
    ("digitalocean-oauth", "x doo" + "_v1_" + fill(HEX, 64), f"x {R}", "x doo" + "_v1_" + fill(HEX, 63)),
    ("stripe-secret-key", "x sk" + "_live_" + fill(ALNUM, 24), f"x {R}", "x sk" + "_live_" + fill(ALNUM, 23)),
    ("stripe-test-key", "x sk" + "_test_" + fill(ALNUM, 24), f"x {R}", "x sk" + "_test_" + fill(ALNUM, 23)),
    ("stripe-restricted-key", "x rk" + "_live_" + fill(ALNUM, 24), f"x {R}", "x rk" + "_live_" + fill(ALNUM, 23)),
    ("twilio-account-sid", "xA" + "C" + fill(HEX, 32), f"x{R}", "xA" + "C" + fill(HEX, 31)),
    ("twilio-api-key", "xS" + "K" + fill(HEX, 32), f"x{R}", "xS" + "K" + fill(HEX, 31)),
    ("sendgrid-api-key", "x S" + "G." + fill(ALNUM, 22) + "." + fill(ALNUM, 43), f"x {R}", "x S" + "G." + fill(ALNUM, 22) + "." + fill(ALNUM, 42)),
    ("mailgun-api-key", "x ke" + "y-" + fill(HEX, 32), f"x {R}", "x ke" + "y-" + fill(HEX, 31)),
    ("npm-token", "x np" + "m_" + fill(ALNUM, 36), f"x {R}", "x np" + "m_" + fill(ALNUM, 35)),
    ("pypi-token", "x pyp" + "i-" + fill(ALNUM, 50), f"x {R}", "x pyp" + "i-" + fill(ALNUM, 49)),
    ("heroku-api-key", "Heroku_Api_" + "Key=" + fill("a1-", 36), f"Heroku_Api_Key={R}", "Heroku_Api_" + "Key=abc"),
    ("shopify-access-token", "x shp" + "at_" + fill(HEX, 32), f"x {R}", "x shp" + "at_" + fill(HEX, 31)),
    ("shopify-shared-secret", "x shp" + "ss_" + fill(HEX, 32), f"x {R}", "x shp" + "ss_" + fill(HEX, 31)),
    ("square-access-token", "x sq0" + "atp-" + fill(ALNUM, 22), f"x {R}", "x sq0" + "atp-" + fill(ALNUM, 21)),
    ("square-oauth-secret", "x sq0" + "csp-" + fill(ALNUM, 43), f"x {R}", "x sq0" + "csp-" + fill(ALNUM, 42)),
    ("datadog-api-key", "dd_api_" + "key=" + fill(HEX, 32), f"dd_api_key={R}", "dd_api_" + "key=abc"),
    ("newrelic-api-key", "x NR" + "AK-" + fill(UPPER, 27), f"x {R}", "x NR" + "AK-" + fill(UPPER, 26)),
    ("vault-token", "vault_token=s.abc", f"vault_token={R}", "vault_token=x.abc"),
    ("mongodb-connection-string", "mongodb+srv://me:pw@h", f"mongodb://[user]:{R}@h", "mongodb://h:1"),
    ("generic-secret-assignment", "my_Auth-x : abcdefgh", f"my_Auth-x : {R}", "my_auth: abcdefg"),
    ("inline-secret-var", "SECRET=abc run", f"SECRET={R} run", "MY_SECRET=abc run"),
    ("curl-password-data", "curl -d 'a=1&token=abc'", f"curl -d 'a=1&token={R}'", "curl -d 'a=1&tok=abc'"),
    ("docker-secret-env", "docker run -e A_TOKEN_B=abc i", f"docker run -e A_TOKEN_B={R} i", "docker run -e A=abc i"),
    ("kubectl-secret", "k --from-literal=db-key=abc", f"k --from-literal=db-key={R}", "k --from-literal=db=abc"),
]
DROPPED = [
    ("private-key", "echo -----BEGIN EC PRIVATE " + "KEY-----", "echo -----BEGIN PUBLIC " + "KEY-----"),
    ("pgp-private-key", "-----BEGIN PGP PRIVATE " + "KEY BLOCK-----", "-----BEGIN PGP PUBLIC " + "KEY BLOCK-----"),
]


def run(spark, texts, extra=()):
    df = spark.createDataFrame([("h", i, t) for i, t in enumerate(texts)], "history_id string, number bigint, command string")
    return r.mark(df, extra).orderBy("number")


def test_catalogue():
    names = [rule.name for rule in RULES]
    assert len(names) == len(set(names)) == 62
    covered = {c[0] for c in CASES} | {c[0] for c in DROPPED}
    # a header value is always replaced by one of the two rules before
    assert set(names) - covered == {"auth-header-h-flag"}


def test_each_rule_fires_and_spares(spark):
    rows = run(spark, [c[1] for c in CASES]).collect()
    spared = run(spark, [c[3] for c in CASES]).collect()
    for (name, text, expected, _), row, other in zip(CASES, rows, spared):
        fired = [RULES[i - 1].name for i in row["fired"]]
        assert name in fired, (name, fired)
        assert row["command"] == expected, name
        assert name not in [RULES[i - 1].name for i in other["fired"]], name
        assert row["original"] == text


def test_header_counts_once(spark):
    row = run(spark, ['curl -H "Authorization: Bearer abc" u']).first()
    assert row["command"] == f'curl -H "Authorization: Bearer {R}" u'
    assert [RULES[i - 1].name for i in row["fired"]] == ["bearer-token"]


def test_removal_erases_other_records(spark):
    texts = [f"db --token abc {t}" for _, t, _ in DROPPED] + [t for _, _, t in DROPPED]
    marked = run(spark, texts)
    assert [x["number"] for x in r.surviving(marked).collect()] == [2, 3]
    records = r.audit(marked, strict=True).orderBy("number").collect()
    assert [x["rule"] for x in records] == [d[0] for d in DROPPED]
    assert [x["original"] for x in records] == texts[:2]
    df = spark.createDataFrame([(texts[0],), (None,)], "command string")
    assert [x[0] for x in df.select(r.redact("command")).collect()] == [r.PLACEHOLDER, None]


def test_unremarkable_commands_stay(spark):
    texts = ["pwd", "svn up", "docker build -t i .", "kubectl get nodes", "npm install left", "cat /etc/fstab", "echo hi"]
    assert [x["command"] for x in run(spark, texts).collect()] == texts


def test_custom_rules_and_allowlist(spark):
    extra = [Rule("ticket", r"(T-)(\d+)", "${1}${2}0"), Rule("gone", "^forget", drop=True)]
    marked = run(spark, ["see T-12", "forget it", "T-1 token=abcdefghi"], extra)
    assert [x["command"] for x in r.surviving(marked).collect()] == ["see T-120", f"T-10 token={R}"]
    assert {x["rule"] for x in r.audit(marked, extra).collect()} == {"ticket", "gone", "generic-secret-assignment"}
    df = spark.createDataFrame([("see T-12",), ("forget it",)], "command string")
    assert [x[0] for x in df.select(r.redact("command", extra)).collect()] == ["see T-120", r.PLACEHOLDER]
    many = [Rule(f"n{i}", f"zz{i}$", "x") for i in range(60)]
    assert run(spark, ["zz59"], many).first()["command"] == "x"
    assert df.select(r.redact("command", many)).count() == 2
    same = r.mark(spark.createDataFrame([("--token abc",)], "command string"), allowlist=["abc"])
    assert same.first()["command"] == f"--token {R}"


def test_quotes_and_backslashes_in_literals(spark):
    texts = ["", "'", "''", 'a"b', "a\\b", "\\'", "'a'\\"]
    for text in texts:
        assert spark.sql(f"select {r._literal(text)} as t").first()["t"] == text


FRAGMENTS = (
    [c[1] for c in CASES]
    + [c[3] for c in CASES]
    + [c[1] for c in DROPPED]
    + [" ", "  ", "\t", "\v", "\f", "\r", "\n", "é", "ſ", "K", "İ", "ı", "'", '"', "=", ":", "@", "://", "-d ", "-p", "_", "paſsword=abcdefgh1", "toKen: abcdefgh1", " ", "export ", "TOKEN=", "&se=", "\U0001f511"]
)


def test_chain_equals_re2(spark):
    rnd = random.Random(11)
    texts = list(FRAGMENTS)
    for _ in range(3000):
        parts = [rnd.choice(FRAGMENTS) for _ in range(rnd.randint(1, 5))]
        text = rnd.choice(["", " "]).join(parts)
        if rnd.random() < 0.3:
            cut = rnd.randint(0, len(text))
            text = text[:cut] + rnd.choice(["", " ", "é", "x", "'"]) + text[cut + 1 :]
        texts.append(text)
    got = [(x["command"], x["fired"], x["dropped"]) for x in run(spark, texts).collect()]
    con = duckdb.connect()
    con.execute("create table t (number bigint, command varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    sql = oracle.redacted("t", "number", "command", "m")
    want = con.sql(f"with {sql} select c, fired, dead from m order by number").fetchall()
    for text, g, w in zip(texts, got, want):
        if w[2] is not None:
            assert g[2] == w[2], text
        else:
            assert (g[0], list(g[1]), g[2]) == (w[0], list(w[1]), None), text


# pieces in which names, blanks, quotes and runs of the rules that are matched run by run meet
RUN_PIECES = {
    "jwt-token": ["eyJ", "e" + "yJa", "a", "-", "--", "_", ".", "." + "eyJb", " ", "é", "'", "x" * 20],
    "inline-secret-var": ["TOKEN", "API_KEY", "SECRET=", "PASSWORD", "=", "=x", " ", "  ", "'", '"', "\n", "\v", "a", "_", "é", "-"],
    "secret-export": ["export", "export ", " ", "\t", "A_", "SECRET", "API_KEY", "APIKEY", "PASS", "WORD", "TOKEN", "CRED", "S", "=", "x", "'", '"'],
    "docker-secret-env": ["-e", "-e ", " ", "A_", "TOKEN", "API_KEY", "=", "x", "--from-literal=", "key", "secret", "-"],
}


@pytest.mark.parametrize("name", RUN_PIECES)
def test_rules_by_run_equal_re2(spark, name):
    rnd = random.Random(name)
    texts = ["".join(rnd.choice(RUN_PIECES[name]) for _ in range(rnd.randint(1, 14))) for _ in range(6000)]
    got = [(x["command"], list(x["fired"])) for x in run(spark, texts).collect()]
    con = duckdb.connect()
    con.execute("create table t as select unnest(?) as command, unnest(?) as number", [texts, list(range(len(texts)))])
    sql = oracle.redacted("t", "number", "command", "m")
    want = con.sql(f"with {sql} select c, fired from m order by number").fetchall()
    assert [(c, list(f)) for c, f in want] == got
    numbers = {RULES[i - 1].name for _, fired in got for i in fired}
    assert name in numbers


def big(*parts, size=1_000_000):
    """About a megabyte: the parts, the one that is a tuple repeated to fill it."""
    rest = sum(len(p) for p in parts if isinstance(p, str))
    return "".join(p if isinstance(p, str) else p[0] * ((size - rest) // len(p[0])) for p in parts)


@pytest.mark.parametrize(
    "text",
    [
        big("password= x ", ("-d a ",)),
        big(("-d a ",), "-d password= xy"),
        big(("-d a ",), "' -d token:x "),
        big(("-d a ",), "-d password=&"),
        big(("-d 'a' ",), "-d 'password=xy'"),
        big("://a:", (":b ",)),
        big(("mongodb://x",)),
        big("password", (" ",)),
        big("Authorization: Bearer ", ("abc ",)),
        big("export ", ("PASSWORD",)),
        big("export ", ("PASSWORD",), "=x"),
        big("-e ", ("TOKEN",)),
        big("--from-literal=", ("token-",)),
        big(("-e" + "yJa",), " x." + "eyJ"),
        big("." + "eyJ ", ("-e" + "yJa",), "." + "eyJ."),
        big(("e" + "yJa.",)),
        big("e" + "yJa." + "eyJb.", ("-",)),
        big("export", (" ",)),
        big("export", (" ",), "A=x"),
        big(("export ",)),
        big("export SECRET", (" ",), "="),
        big("export ", ("SECRET",), "="),
        big("export ", ("CREDS",), "='' "),
        big("-e", (" ",), "TOKEN=x"),
        big("-e ", ("TOKEN",), "= "),
        big("--from-literal=", ("key",), "= "),
        big(("TOKEN=",)),
        big(("TOKEN=",), "'x"),
        big("TOKEN", (" ",)),
        big("TOKEN =", (" ",)),
        big(("SECRET ",)),
        big(("-SECRET",), " = 'x'"),
    ],
)
def test_a_megabyte_takes_seconds(spark, text):
    import time

    start = time.perf_counter()
    df = spark.createDataFrame([(text,)], "command string")
    got = df.select(r.redact("command").alias("t")).first()["t"]
    assert time.perf_counter() - start < 20
    assert got is not None


def test_any_number_of_extra_rules(spark):
    rules = [r.Rule(f"gone{i}", f"^gone{i}x", "", drop=True) for i in range(100)]
    rules += [r.Rule(f"new{i}", f"old{i}x", f"new{i}") for i in range(100)]
    texts = ["gone7x", "gone99x", "old3x and old42x", "plain", None, "gone100x"]
    df = spark.createDataFrame([("h", i, t) for i, t in enumerate(texts)], "history_id string, number int, command string")
    column = [x["c"] for x in df.orderBy("number").select(r.redact("command", rules).alias("c")).collect()]
    assert column == [r.PLACEHOLDER, r.PLACEHOLDER, "new3 and new42", "plain", None, "gone100x"]
    marked = r.mark(df, rules).orderBy("number").collect()
    assert [r.PLACEHOLDER if x["dropped"] else x["command"] for x in marked] == column


def test_long_text_is_linear(spark):
    words = " ".join(["see http://host/path -d token auth word"] * 20_000)
    row = run(spark, [words]).first()
    assert row["command"] == words
    assert java_pattern(RULES[0].pattern)
