import random
import re
import time
from collections import defaultdict

import pytest
from helpers import dicts
from pyspark.sql import functions as F

from lintharbor import rules
from lintharbor.operators import detect as dt
from lintharbor.operators import rollup as ru

HEX40 = "0123456789abcdef0123456789abcdef01234567"
A = "Ab1" * 30
SECRETS = [
    ("SEC01", f"key = AKIA{'A1' * 8}"), ("SEC02", f"aws_secret_access_key = '{A[:40]}'"),
    ("SEC03", f"t: ghp_{A[:36]}"), ("SEC03", f"github_pat_{A[:30]}"), ("SEC04", f"AIza{A[:35]}"),
    ("SEC05", f"sk_live_{A[:24]}"), ("SEC06", f"SG.{A[:22]}.{A[:43]}"), ("SEC07", f"SK{HEX40[:32]}"),
    ("SEC08", f"key-{HEX40[:32]}"), ("SEC09", "-----BEGIN RSA PRIVATE KEY-----"),
    ("SEC09", "-----BEGIN PGP PRIVATE KEY BLOCK-----"), ("SEC10", "mongodb+srv://u:pw@host/db"),
    ("SEC11", "mysql://u:pw@host/db"), ("SEC12", "postgresql://ledger:qu1etRiver@db7/books"),
    ("SEC13", f"eyJ{A[:20]}.eyJ{A[:20]}.sig_x"), ("SEC14", f"ya29.{A[:30]}"),
    ("SEC15", f'token = "{HEX40}"'), ("SEC15", f"x token = &quot;{HEX40}&quot; y"),
    ("SEC15", f"ACCESS_TOKEN='{HEX40}'"), ("SEC16", 'API_KEY = "weather-98bd0cc17e"'),
    ("SEC16", "let mapsApiKeyOld = 'tiles-5502ffab81';"), ("SEC17", "let ledgerPassword = 'qu1etRiver';"),
    ("SEC17", 'password: "hunter22"'), ("SEC18", "https://bob:s3cret@example.org/x"),
]
HARMLESS = [
    "maps_key = settings.require('MAPS_KEY')", "let tilesApiKey = settings.tilesApiKey;", "password = getpass()",
    "session.run(f\"select n from door where password = '{password}'\")", "https://example.org:8080/a@b",
    "XAKIA" + "A1" * 8, "task-" + "a" * 40, "mysql://localhost/db", "a tokens = many", "token = \"short\"",
    "-----BEGIN PUBLIC KEY-----", "monkey-" + "b" * 32,
]


def texts(spark, rows):
    return spark.createDataFrame([("p", str(i), t) for i, t in enumerate(rows)],
                                 "project string, path string, text string")


def test_every_secret_type_is_found(spark):
    got = dicts(dt.secret_detection(texts(spark, [t for _, t in SECRETS])))
    found = {}
    for g in got:
        found.setdefault(int(g["path"]), []).append(g["rule_id"])
    assert {i: found.get(i) for i in range(len(SECRETS))} == {i: [r] for i, (r, _) in enumerate(SECRETS)}
    assert {r for r, _ in SECRETS} == {r.rule_id for r in rules.SECRET_RULES}


def test_harmless_lines(spark):
    assert dicts(dt.secret_detection(texts(spark, HARMLESS))) == []


def test_positions_overlaps_and_redaction(spark):
    secret = "AKIA" + "Z9" * 8
    text = f"first\n\napi_key = \"{secret}\"  # and token = '{HEX40}'\nkey={secret} mysql://u:pw@h/x\n"
    got = dicts(dt.secret_detection(texts(spark, [text])), "line", "column")
    # The generic key rule yields to the specific one; the second secret on the line is kept.
    assert [(g["line"], g["column"], g["nth"], g["rule_id"]) for g in got] == [
        (3, 12, 1, "SEC01"), (3, 41, 2, "SEC15"), (4, 5, 1, "SEC01"), (4, 26, 2, "SEC11")]
    assert {g["code"] for g in got} == {"[REDACTED]"}
    assert secret not in str(got) and HEX40 not in str(got)


def test_several_secrets_of_one_rule_on_a_line(spark):
    token = f"ghp_{A[:36]}"
    key = "ASIA" + "Q7" * 8
    text = f"é\U0001F600 {token} {token},{token}\n{key} {key} {key}"
    got = dicts(dt.secret_detection(texts(spark, [text])), "line", "column")
    assert [(g["line"], g["column"], g["rule_id"]) for g in got] == [
        (1, 4, "SEC03"), (1, 45, "SEC03"), (1, 86, "SEC03"), (2, 1, "SEC01"), (2, 22, "SEC01"), (2, 43, "SEC01")]
    far = f"aws{'_' * 26}secret{'.' * 40} = '{A[:40]}'"
    assert [(g["rule_id"], g["column"]) for g in dicts(dt.secret_detection(texts(spark, [far])))] == [("SEC02", 1)]
    # Rows alike are rows of their own.
    assert dt.secret_detection(texts(spark, [text]).unionAll(texts(spark, [text]))).count() == 12


def swept(line):
    """(column, rule) of a line: every match of every rule, then the sweep, in plain Python."""
    found = []
    for rank, r in enumerate(rules.SECRET_RULES):
        before = "(?<![A-Za-z0-9_])" if r.whole_word else ""
        after = f"(?![{r.not_after}])" if r.not_after else ""
        found += [(r.generic, m.start(), -m.end(), rank) for m in re.finditer(before + r.core + after, line, re.ASCII)]
    kept = []
    for m in sorted(found):
        if not any(k[1] < -m[2] and m[1] < -k[2] for k in kept):
            kept.append(m)
    return sorted((start + 1, rules.SECRET_RULES[rank].rule_id) for _, start, _, rank in kept)


def test_places_equal_a_plain_sweep(spark):
    r = random.Random(8)
    pieces = [t for _, t in SECRETS] + HARMLESS + ["'", '"', " ", "_", "=", "aws_", "x"]
    lines = ["".join(r.choice(pieces) + r.choice(["", " ", ", ", "_"]) for _ in range(r.randint(1, 9))) for _ in range(300)]
    got = defaultdict(list)
    for g in dicts(dt.secret_detection(texts(spark, ["\n".join(lines)]))):
        got[g["line"]].append((g["column"], g["rule_id"]))
    assert {n: sorted(x) for n, x in got.items()} == {n: swept(t) for n, t in enumerate(lines, 1) if swept(t)}


def test_a_line_of_very_many_secrets(spark):
    line = f"ghp_{A[:36]} " * 20_000
    start = time.time()
    got = dt.secret_detection(texts(spark, [line])).agg(F.count("*"), F.max("column"), F.max("nth")).first()
    assert tuple(got) == (20_000, 41 * 19_999 + 1, 20_000)
    assert time.time() - start < 30


def test_whole_text_filter_misses_no_line(spark):
    """Brute force: each line by itself, without the text-level steps."""
    lines = [t for _, t in SECRETS] + HARMLESS
    corpus = ["\n".join(lines[i::5] + lines[:i]) for i in range(5)]
    got = {(int(g["path"]), g["line"], g["column"], g["rule_id"]) for g in dicts(dt.secret_detection(texts(spark, corpus)))}
    assert got == {(i, n, *m) for i, text in enumerate(corpus) for n, line in enumerate(text.split("\n"), 1) for m in swept(line)}


def test_every_rule_has_a_keyword_in_every_example():
    by_id = {r.rule_id: r for r in rules.ALL_RULES}
    for rule_id, text in SECRETS:
        assert any(k in text for k in by_id[rule_id].keywords), rule_id


@pytest.mark.parametrize("piece", ["-", "a.", "token ", "://a:b", "A1 ", "key-", "\"select ", "f\"<", "x=" * 3])
def test_long_lines_stay_fast(spark, piece):
    long = texts(spark, [piece * (200_000 // len(piece))])
    start = time.time()
    dt.secret_detection(long).count()
    dt.vulnerable_pattern_scan(long.withColumn("language", F.lit("python"))).count()
    dt.vulnerable_pattern_scan(long.withColumn("language", F.lit("javascript"))).count()
    assert time.time() - start < 30


def test_lines_are_numbered_from_one(spark):
    got = dicts(dt.explode_lines(texts(spark, ["a\n\nb\n", ""])), "path", "line")
    assert [(g["path"], g["line"], g["content"]) for g in got] == [
        ("0", 1, "a"), ("0", 2, ""), ("0", 3, "b"), ("0", 4, ""), ("1", 1, "")]


# Faults in the words of other projects: (language, line, family of the rule).
ELSEWHERE = [
    ("python", "cur.run(\"SELECT a FROM seats WHERE row = \" + row_no)", "SQL"), ("python", "cur.run('delete from seats where row=%s' % row_no)", "SQL"),
    ("python", "q = f\"\"\"SELECT a FROM seats WHERE b = {b}\"\"\"", "SQL"), ("python", "db.run(\"INSERT INTO seats VALUES ('{}')\".format(v))", "SQL"),
    ("python", "os.system('rm -rf ' + folder)", "CMD"), ("python", "subprocess.run(f\"ls {d}\", shell=True)", "CMD"),
    ("python", "subprocess.Popen(line, shell = True)", "CMD"), ("python", "os.popen(\"cat %s\" % name)", "CMD"),
    ("javascript", "child_process.exec('ls ' + dir)", "CMD"), ("javascript", "exec(`rm ${f}`)", "CMD"),
    ("javascript", "document.write(location.hash)", "XSS"), ("javascript", "node.outerHTML = value", "XSS"),
    ("javascript", "$('#seat').html(req.body.seat)", "XSS"), ("python", "return \"<h1>\" + request.args[\"seat\"]", "XSS"),
    ("python", "open('/seats/' + name)", "PTH"), ("python", "yaml.load(data)", "DES"), ("python", "cPickle.loads(data)", "DES"),
    ("python", "x = eval(formula)", "DES"), ("javascript", "new Function(body)()", "DES"), ("python", "t = random.getrandbits(64)", "RND"),
    ("python", "hashlib.new('sha1', seat)", "CRY"), ("javascript", "crypto.createHash('md5')", "CRY"), ("python", "DEBUG = True", "DBG"),
    ("python", "app.run(debug=True)", "DBG"), ("python", "urllib.request.urlopen(link)", "SRF"), ("javascript", "axios.get(link)", "SRF"),
    ("javascript", "fetch(req.query.link)", "SRF"), ("python", "lxml.etree.parse(f)", "XXE"), ("python", "ET.parse(upload)", "XXE"),
    ("python", "requests.get(link)", "SRF"),
]


def test_faults_in_other_words(spark):
    """Lines that no rule was written for: nine of ten are found, each by a rule of its family (eval in Python is not)."""
    df = spark.createDataFrame([("p", str(i), lang, text) for i, (lang, text, _) in enumerate(ELSEWHERE)],
                               "project string, path string, language string, text string")
    found = {}
    for g in dicts(dt.vulnerable_pattern_scan(df)):
        found.setdefault(int(g["path"]), set()).add(g["rule_id"][:3])
    assert sum(ELSEWHERE[i][2] in found.get(i, ()) for i in range(len(ELSEWHERE))) >= 0.9 * len(ELSEWHERE)


def test_a_file_with_faults_of_many_kinds(spark):
    lines = [(text, fam) for lang, text, fam in ELSEWHERE if lang == "python" and "eval" not in text]
    df = spark.createDataFrame([("p", "a.py", "python", "\n\n".join(t for t, _ in lines))],
                               "project string, path string, language string, text string")
    got = dicts(dt.vulnerable_pattern_scan(df))
    assert {(g["line"], g["rule_id"][:3]) for g in got} >= {(1 + 2 * i, fam) for i, (_, fam) in enumerate(lines)}
    assert all(g["line"] % 2 for g in got)


SAFE = [
    ("python", "banner = render('greeting.html', title=greeting)"), ("javascript", "panel.textContent = row.caption;"),
    ("javascript", "notes.insertOne({ owner: 7, body: cleaned });"), ("javascript", "if (panel.innerHTML == before) stop();"),
    ("python", "rows = session.run('select n from stock where sku = :s', {'s': sku})"),
    ("javascript", "pool.run('update stock set n = ? where sku = ?', [0, sku]);"),
    ("python", "done = subprocess.check_output(['du', '-sh', folder])"),
    ("javascript", "spawnSync('tar', ['xf', archive]);"),
    ("python", "reply = send_file(invoice.path)"), ("javascript", "reply.sendFile(avatar.path);"),
    ("python", "table = json.load(f)"), ("javascript", "rule = parseFormula(row.formula);"),
    ("python", "voucher = secrets.choice(LETTERS)"), ("javascript", "let nonce = webcrypto.getRandomValues(buffer);"),
    ("python", "seal = hashlib.sha256(page)"), ("javascript", "const seal = createHash('sha512').update(page);"),
    ("python", "feed = safe_xml.fromstring(upload.read())"), ("javascript", "reader.parseString(await upload.text());"),
    ("python", "server.run(port=8000, debug=settings.verbose)"), ("javascript", "journal.error(problem.stack);"),
    ("python", "feed = requests.head(mirror_address, timeout=3)"), ("javascript", "const feed = await fetch(known.address);"),
    ("python", "rows = session.run('select n from stock where sku = %s', (sku,))"), ("python", "share = 100 * part % whole"),
    ("python", "done = subprocess.run(['gzip', name], check=True)"), ("python", "notes = open('/srv/notes.txt').read()"),
    ("python", "plan = yaml.load(upload, Loader=SafeLoader)"), ("python", "plan = yaml.safe_load(upload)"), ("python", "rule = ast.literal_eval(text)"),
    ("python", "model.eval()"), ("python", "DEBUG = settings.verbose"), ("javascript", "pattern.exec('a' + b);"), ("javascript", "document.write('<hr>');"),
    ("python", "page = '<li>' + escape(row) + '</li>'"), ("javascript", "const f = function (row) { return row; };"),
]


def test_safe_code_is_not_reported(spark):
    df = spark.createDataFrame([("p", str(i), lang, t) for i, (lang, t) in enumerate(SAFE)],
                               "project string, path string, language string, text string")
    assert dicts(dt.vulnerable_pattern_scan(df)) == []


def test_language_limits_rules(spark):
    df = spark.createDataFrame(
        [("p", "a", "python", "eval(x)"), ("p", "b", "typescript", "eval(x)"), ("p", "c", None, "eval(x)")],
        "project string, path string, language string, text string")
    assert [g["path"] for g in dicts(dt.vulnerable_pattern_scan(df))] == ["b"]


def test_missing_controls(spark):
    rows = [
        ("python", "@shop.route('/refund', methods=['POST'])\ndef refund():  # no CSRF here\n    return 1", {"CSR01"}),
        ("python", "guard = CSRFProtect(shop)\n@shop.route('/refund', methods=['POST'])", set()),
        ("javascript", "app.post('/refund', book);", {"CSR02"}),
        ("javascript", "app.post('/refund', csrfProtection, book);", set()),
        ("python", "shop = Flask(__name__)\nTalisman(shop)", set()), ("javascript", "const shop = express();", {"HDR02"}),
        ("python", "@app.route('/invoice/<invoice_id>')\n@login_required", set()),
        ("javascript", "app.put('/invoice/:id', draw);", {"ACC02"}),
        ("javascript", "app.put('/invoice/:id', authenticate, draw);", set()),
        ("javascript", "members.deleteOne({\n  mail: req.params.mail,\n});", {"NOS01"}),
        ("javascript", "if (typeof req.params.mail === 'object') {}\nmembers.deleteOne({\n  mail: req.params.mail,\n});", set()),
        ("markdown", "shop = Flask(__name__)", set()),
    ]
    df = spark.createDataFrame([("p", str(i), lang, t) for i, (lang, t, _) in enumerate(rows)],
                               "project string, path string, language string, text string")
    found = {}
    for g in dicts(dt.missing_control_scan(df)):
        found.setdefault(int(g["path"]), set()).add(g["rule_id"])
    assert {i: found.get(i, set()) for i in range(len(rows))} == {i: r[2] for i, r in enumerate(rows)}


def test_custom_rule_levels(spark):
    hits = spark.createDataFrame([("p", "a", 1, "X", "low"), ("p", "a", 2, "Y", "low"), ("p", "a", 3, "Z", "low"),
                                  ("q", "a", 1, "X", "low"), ("p", "a", 4, "W", "low")],
                                 "project string, path string, line int, rule_id string, severity string")
    levels = spark.createDataFrame([("p", "X", "off"), ("p", "Y", "ERROR"), ("p", "Z", "warn")],
                                   "project string, rule_id string, level string")
    got = dicts(dt.custom_rules(hits, levels), "project", "line")
    assert [(g["project"], g["rule_id"], g["severity"]) for g in got] == [
        ("p", "Y", "high"), ("p", "Z", "medium"), ("p", "W", "low"), ("q", "X", "low")]


def test_every_rule_has_a_remedy_and_category(spark):
    names = dict(rules.OWASP_CATEGORIES)
    assert len(names) == 10
    assert all(r.owasp in names and r.family in dict(rules.REMEDIES) for r in rules.ALL_RULES)
    hits = spark.createDataFrame([("CRY01",), ("nope",)], "rule_id string")
    got = {g["rule_id"]: g for g in dicts(dt.remediation_lookup(hits))}
    assert got["CRY01"]["owasp_category"] == "A02:2021 - Cryptographic Failures"
    assert got["nope"]["secure_pattern"] is None


def test_owasp_rollup_keeps_zero_rows(spark):
    f = spark.createDataFrame(
        [("p", ["A03:2021 - Injection", "A01:2017 - Injection"]), ("p", ["A10"]), ("p", ["A07:2017"]), ("p", None), ("q", [])],
        "project string, owasp array<string>")
    got = dicts(dt.owasp_rollup(f), "project", "category")
    assert len(got) == 20
    assert {(g["project"], g["category"]): g["n_findings"] for g in got if g["n_findings"]} == {
        ("p", "A03"): 1, ("p", "A10"): 1}


def test_secret_rollup_counts_files(spark):
    same = f'token = "{HEX40}"\n'
    got = dicts(ru.secret_type_rollup(dt.secret_detection(texts(spark, [same * 3, same]))))
    assert [(g["title"], g["n_secrets"], g["n_files"]) for g in got] == [("Access Token", 4, 2)]


def test_hits_become_findings(spark):
    from lintharbor import schemas

    code = spark.createDataFrame(
        [("p", "s", i, f"f{i}.py", "python", "\n" * i + f"h = hashlib.md5(x)  # token = '{HEX40}'") for i in range(3)],
        "project string, scan_id string, file_no int, path string, language string, text string")
    secrets = dt.as_findings(dt.secret_detection(code), "Secret Scanner")
    weak = dt.as_findings(dt.vulnerable_pattern_scan(code), "Pattern Scanner")
    assert secrets.columns == weak.columns == schemas.FINDING_COLUMNS
    both = secrets.unionByName(weak)
    assert [(g["file"], g["line"], g["rule_id"]) for g in dicts(both, "seq")] == [
        (f, n, r) for f, n in (("f0.py", 1), ("f1.py", 2), ("f2.py", 3)) for r in (None, "CRY01")]
    assert dicts(secrets, "seq")[0]["title"] == "Exposed secret: Access Token"
    assert HEX40 not in str(dicts(both)) and dicts(weak)[0]["owasp"] == ["A02"]
    assert dicts(weak, "seq")[0]["code"] == "h = hashlib.md5(x)  #  [REDACTED] "
    (b,) = dicts(ru.severity_buckets(both))
    assert (b["high_count"], b["medium_count"], b["secrets_found"]) == (3, 3, 3)
