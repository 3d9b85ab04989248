"""Detection rules and the category catalogue: small fixed tables, driver-side literals.

Patterns use only syntax common to java.util.regex and RE2: no look-around, no back-references,
no `\\b` (its treatment of non-ASCII letters differs between engines).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule_id: str
    title: str
    family: str
    owasp: str
    severity: str
    pattern: str
    languages: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()  # every match contains one of these, a cheap pre-check
    generic: bool = False           # yields to specific rules on the same text
    guard: str | None = None        # whole-file rule: reported when the guard is absent
    core: str = ""                  # the secret itself, without what stands around it
    whole_word: bool = False        # no letter, digit or `_` stands before the core
    not_after: str = ""             # class of the characters that may not follow the core


START = r"(?:^|[^A-Za-z0-9_])"
QUOTE = r"(?:[\"'`]|&quot;|&#39;|&#x27;)"
ASSIGN = r"[\"']?\s*[:=]\s*"
USERINFO = r"[^\s:@/\"'<>{}$]+:[^\s:@/\"'<>{}$]+@"


def _secret(rule_id, title, severity, keywords, core, whole_word=True, not_after="", generic=False):
    pattern = (START if whole_word else "") + core + (f"(?:$|[^{not_after}])" if not_after else "")
    return Rule(rule_id, title, "Hardcoded secrets", "A07", severity, pattern, (), tuple(keywords.split(" ")), generic,
                core=core, whole_word=whole_word, not_after=not_after)


# Specific formats are the vendors' public ones. Generic rules look at names and quoting only.
# Words come in their usual spellings instead of (?i), so that the literal check covers them.
SECRET_RULES = [
    _secret("SEC01", "AWS Access Key", "critical", "AKIA ASIA",
            r"(?:AKIA|ASIA)[0-9A-Z]{16}", not_after="0-9A-Z"),
    _secret("SEC02", "AWS Secret Key", "critical", "aws AWS Aws",
            r"(?:aws|AWS|Aws)[A-Za-z_.\-]*(?:secret|SECRET|Secret|key|KEY|Key)[A-Za-z_.\-]*"
            + ASSIGN + QUOTE + r"[A-Za-z0-9/+]{40}" + QUOTE, whole_word=False),
    _secret("SEC03", "GitHub Token", "critical", "ghp_ gho_ ghu_ ghs_ ghr_ github_pat_",
            r"(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22})"),
    _secret("SEC04", "Google API Key", "high", "AIza", r"AIza[0-9A-Za-z_\-]{35}"),
    _secret("SEC05", "Stripe Key", "critical", "k_live_ k_test_",
            r"[sr]k_(?:live|test)_[0-9A-Za-z]{16}"),
    _secret("SEC06", "SendGrid Key", "high", "SG.",
            r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16}"),
    _secret("SEC07", "Twilio Key", "high", "SK", r"SK[0-9a-f]{32}", not_after="0-9A-Za-z"),
    _secret("SEC08", "Mailgun Key", "high", "key-", r"key-[0-9a-zA-Z]{32}", not_after="0-9A-Za-z"),
    _secret("SEC09", "Private Key", "critical", "-----BEGIN",
            r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", whole_word=False),
    _secret("SEC10", "MongoDB Connection String", "critical", "mongodb",
            r"mongodb(?:\+srv)?://" + USERINFO),
    _secret("SEC11", "MySQL Connection String", "critical", "mysql",
            r"mysql(?:\+[a-z0-9]+)?://" + USERINFO),
    _secret("SEC12", "PostgreSQL Connection String", "critical", "postgres",
            r"postgres(?:ql)?(?:\+[a-z0-9]+)?://" + USERINFO),
    _secret("SEC13", "JWT Token", "high", "eyJ",
            r"eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]+"),
    _secret("SEC14", "OAuth Token", "high", "ya29.", r"ya29\.[0-9A-Za-z_\-]{20}"),
    _secret("SEC15", "Access Token", "high", "token TOKEN Token",
            r"(?:token|TOKEN|Token)" + ASSIGN + QUOTE + r"[0-9A-Za-z_\-./+=]{16,}" + QUOTE,
            whole_word=False, generic=True),
    _secret("SEC16", "Generic API Key", "high", "api API Api",
            r"(?:api|API|Api)[_\-]?(?:key|KEY|Key)[A-Za-z0-9_]*" + ASSIGN + QUOTE
            + r"[^\s\"'`&{}$<>]{12,}" + QUOTE, whole_word=False, generic=True),
    _secret("SEC17", "Password in Code", "high", "passw Passw PASSW pwd PWD Pwd",
            r"(?:password|passwd|Password|Passwd|PASSWORD|PASSWD|pwd|PWD|Pwd)[A-Za-z0-9_]*" + ASSIGN
            + QUOTE + r"[^\s\"'`&{}$%<>]{4,}" + QUOTE, whole_word=False, generic=True),
    _secret("SEC18", "Password in URL", "high", "://", r"://" + USERINFO, whole_word=False, generic=True),
]

PY = ("python",)
JS = ("javascript", "typescript")


SQL_VERB = r"(?:select|SELECT|insert|INSERT|update|UPDATE|delete|DELETE)"


def _code(rule_id, title, family, owasp, severity, languages, keywords, pattern):
    return Rule(rule_id, title, family, owasp, severity, pattern, languages,
                tuple(keywords.split(" ")))


CODE_RULES = [
    _code("XSS01", "HTML built from a request value", "Reflected XSS", "A03", "high", PY, "f\"< f'<",
          r"f[\"']<[^\"'{]*\{[A-Za-z_][A-Za-z0-9_.]*\}"),
    _code("XSS02", "innerHTML assignment", "Reflected XSS", "A03", "high", JS, ".innerHTML",
          r"\.innerHTML\s*\+?=[^=]"),
    _code("XSS03", "Request value stored unchecked", "Stored XSS", "A03", "high", JS, ".insert",
          r"\.insert(?:One|Many)?\(\s*\{[^}]*:\s*req\.(?:body|query|params)"),
    _code("XSS04", "HTML written from a value", "Reflected XSS", "A03", "high", JS, "document.write .outerHTML .html(",
          r"document\.write(?:ln)?\(\s*[A-Za-z_]|\.outerHTML\s*\+?=[^=]|\.html\(\s*(?:req|location)\."),
    _code("XSS05", "HTML joined with a request value", "Reflected XSS", "A03", "high", PY, "request",
          r"[\"']<[^\"']*[\"']\s*\+\s*request\."),
    _code("SQL01", "SQL built with an f-string", "SQL injection", "A03", "critical", PY, "f\" f'",
          "f\"(?:\"\")?" + SQL_VERB + r"\s[^\"]*\{|f'(?:'')?" + SQL_VERB + r"\s[^']*\{"),
    _code("SQL02", "SQL built with a template literal", "SQL injection", "A03", "critical", JS, "${",
          "`" + SQL_VERB + r"\s[^`]*\$\{"),
    _code("SQL03", "SQL built by concatenation", "SQL injection", "A03", "critical", PY + JS, "+",
          r"[\"']" + SQL_VERB + r"\s[^\"']*[\"']\s*\+\s*[A-Za-z_]"),
    _code("SQL04", "SQL built with a format operator", "SQL injection", "A03", "critical", PY, "% .format(",
          r"(?:\"" + SQL_VERB + r"\s[^\"]*\"|'" + SQL_VERB + r"\s[^']*')\s*(?:%\s*[A-Za-z_(]|\.format\()"),
    _code("CMD01", "Shell command from a formatted string", "Command injection", "A03", "critical",
          PY, "os.system os.popen", START + r"os\.(?:system|popen)\(\s*f[\"']"),
    _code("CMD02", "Shell command from a template literal", "Command injection", "A03", "critical",
          JS, "exec", r"(?:^|[^A-Za-z0-9_.])exec(?:Sync)?\(\s*`[^`]*\$\{"),
    _code("CMD03", "Shell command joined with a value", "Command injection", "A03", "critical", PY, "os.system os.popen",
          START + r"os\.(?:system|popen)\(\s*(?:\"[^\"]*\"|'[^']*')\s*(?:\+|%|\.format\()"),
    _code("CMD04", "Command run through a shell", "Command injection", "A03", "high", PY, "shell",
          START + r"subprocess\.(?:run|call|check_call|check_output|Popen)\(.*shell\s*=\s*True"),
    _code("CMD05", "Shell command joined with a value", "Command injection", "A03", "critical", JS, "exec",
          r"(?:^|[^A-Za-z0-9_.]|child_process\.)exec(?:Sync)?\(\s*(?:\"[^\"]*\"|'[^']*')\s*\+"),
    _code("PTH01", "File path from a formatted string", "Path traversal", "A01", "high", PY,
          "send_file", START + r"send_file\(\s*f[\"'][^\"']*\{"),
    _code("PTH02", "File path from a request parameter", "Path traversal", "A01", "high", JS,
          ".sendFile", r"\.sendFile\(\s*`[^`]*\$\{\s*req\."),
    _code("PTH03", "File path joined with a value", "Path traversal", "A01", "high", PY, "open(",
          r"(?:^|[^A-Za-z0-9_.])open\(\s*(?:\"[^\"]*/\"|'[^']*/')\s*\+\s*[A-Za-z_]"),
    _code("DES01", "Unpickling untrusted data", "Insecure deserialisation", "A08", "critical", PY,
          "ickle.load dill.load marshal.load", START + r"(?:c?[Pp]ickle|dill|marshal)\.loads?\("),
    _code("DES03", "YAML loaded without a safe loader", "Insecure deserialisation", "A08", "high", PY, "yaml.",
          START + r"yaml\.(?:unsafe_load|full_load)\(|" + START + r"yaml\.load\(\s*[A-Za-z_][A-Za-z0-9_.]*(?:\(\))?\s*\)"),
    _code("DES04", "Function made from a text", "Insecure deserialisation", "A08", "critical", JS, "Function(",
          START + r"new\s+Function\("),
    _code("DES02", "eval of a value", "Insecure deserialisation", "A08", "critical", JS, "eval(",
          r"(?:^|[^A-Za-z0-9_.])eval\("),
    _code("RND01", "Predictable random value", "Insecure random", "A02", "medium", PY, "random.",
          r"(?:^|[^A-Za-z0-9_.])random\.(?:random|randint|randrange|choice|choices|sample|uniform|getrandbits)\("),
    _code("RND02", "Predictable random value", "Insecure random", "A02", "medium", JS, "Math.random",
          START + r"Math\.random\(\)"),
    _code("CRY01", "Weak hash algorithm", "Weak cryptography", "A02", "medium", PY, "hashlib.",
          START + r"hashlib\.(?:(?:md5|sha1)\(|new\(\s*[\"'](?:md5|sha1)[\"'])"),
    _code("CRY02", "Weak hash algorithm", "Weak cryptography", "A02", "medium", JS, "createHash",
          r"createHash\(\s*[\"'](?:md5|sha1)[\"']"),
    _code("XXE01", "XML parsed with external entities", "XXE", "A05", "high", PY, ".parse .fromstring",
          START + r"(?:ET|ElementTree|etree)\.(?:parse|fromstring)\("),
    _code("XXE02", "XML parsed with default settings", "XXE", "A05", "high", JS, "xml2js.parseString",
          START + r"xml2js\.parseString\("),
    _code("DBG01", "Debug mode switched on", "Debug exposure", "A05", "medium", PY, "debug DEBUG",
          START + r"(?:debug|DEBUG)\s*=\s*True"),
    _code("DBG02", "Stack trace sent to the client", "Debug exposure", "A05", "medium", JS, ".stack",
          r"\.(?:json|send)\([^)]*\.stack(?:$|[^A-Za-z0-9_])"),
    _code("SES01", "Session id in the URL", "Session handling", "A07", "high", JS, ":session",
          r"\.(?:get|post|put|delete|use)\(\s*[\"'][^\"']*:session"),
    _code("SRF01", "Unchecked URL fetched", "SSRF", "A10", "high", PY, "requests.",
          START + r"requests\.(?:get|post|put|delete|head)\(\s*[A-Za-z_][A-Za-z0-9_]*\s*\)"),
    _code("SRF03", "Unchecked URL fetched", "SSRF", "A10", "high", PY, "urlopen(",
          START + r"(?:request\.|urllib2?\.)*urlopen\(\s*[A-Za-z_][A-Za-z0-9_]*\s*[,)]"),
    _code("SRF04", "Request value fetched as a URL", "SSRF", "A10", "high", JS, "axios fetch( got(",
          r"(?:^|[^A-Za-z0-9_.])(?:axios(?:\.(?:get|post|put|delete|head|request))?|fetch|got)\(\s*req\.|"
          r"(?:^|[^A-Za-z0-9_.])axios\.(?:get|post|put|delete|head)\(\s*[A-Za-z_][A-Za-z0-9_]*\s*[,)]"),
    _code("SRF02", "Unchecked URL fetched", "SSRF", "A10", "high", JS, "fetch(",
          r"(?:^|[^A-Za-z0-9_.])fetch\(\s*[A-Za-z_][A-Za-z0-9_]*\s*\)"),
]


def _absent(rule_id, title, family, owasp, severity, languages, pattern, guard):
    return Rule(rule_id, title, family, owasp, severity, pattern, languages, guard=guard)


CONTROL_RULES = [
    _absent("CSR01", "State-changing route without CSRF protection", "CSRF missing", "A01", "medium",
            PY, r"methods\s*=\s*\[[^\]]*[\"']POST[\"']", r"CSRFProtect|csrf_token|csrf\."),
    _absent("CSR02", "State-changing route without CSRF protection", "CSRF missing", "A01", "medium",
            JS, START + r"app\.post\(\s*[\"']", r"csurf|csrfProtection|csrfToken"),
    _absent("HDR01", "Web application without security headers", "Security headers missing", "A05",
            "low", PY, START + r"Flask\(__name__", r"Talisman\(|Content-Security-Policy|X-Frame-Options"),
    _absent("HDR02", "Web application without security headers", "Security headers missing", "A05",
            "low", JS, r"(?:^|[^A-Za-z0-9_.])express\(\)", r"helmet|Content-Security-Policy|X-Frame-Options"),
    _absent("ACC01", "Object looked up by id without an access check", "Access check missing", "A01",
            "high", PY, r"@app\.route\(\s*[\"'][^\"']*<[^>\"']*id>", r"@login_required|current_user"),
    _absent("ACC02", "Object looked up by id without an access check", "Access check missing", "A01",
            "high", JS, START + r"app\.(?:get|post|put|delete)\(\s*[\"'][^\"']*/:(?:id|[a-z]+Id)[\"']",
            r"authenticate|req\.user|isAdmin"),
    _absent("RAT01", "Login without rate limit", "Login without rate limit", "A07", "medium", PY + JS,
            r"[\"']/login[\"']", r"[Ll]imiter|rate_limit|rateLimit"),
    _absent("LOG01", "Login without logging", "Login without logging", "A09", "low", PY + JS,
            r"[\"']/login[\"']", r"logging\.|logger\.|console\."),
    _absent("NOS01", "Request values used as a query document", "NoSQL injection", "A03", "high", JS,
            r"\.(?:find|findOne|updateOne|deleteOne)\(\s*\{[^}]*:\s*req\.(?:body|query|params)\.",
            r"typeof\s+req\."),
]

# The ten categories.
OWASP_CATEGORIES = [
    ("A01", "Broken Access Control"),
    ("A02", "Cryptographic Failures"),
    ("A03", "Injection"),
    ("A04", "Insecure Design"),
    ("A05", "Security Misconfiguration"),
    ("A06", "Vulnerable and Outdated Components"),
    ("A07", "Identification and Authentication Failures"),
    ("A08", "Software and Data Integrity Failures"),
    ("A09", "Security Logging and Monitoring Failures"),
    ("A10", "Server-Side Request Forgery (SSRF)"),
]

# What to do instead, per family.
REMEDIES = [
    ("Reflected XSS", "Render through an auto-escaping template or set textContent"),
    ("Stored XSS", "Sanitise user input before it is stored"),
    ("SQL injection", "Use parameterised queries or an ORM"),
    ("NoSQL injection", "Check the type of request values before querying"),
    ("Command injection", "Pass an argument list to subprocess.run or execFile"),
    ("Path traversal", "Resolve the path and verify that it stays inside the base folder"),
    ("Insecure deserialisation", "Parse JSON and validate it against a schema"),
    ("CSRF missing", "Enable CSRF tokens on state-changing routes"),
    ("Insecure random", "Use secrets or crypto.randomBytes"),
    ("Hardcoded secrets", "Remove from code and use environment variables or secret manager"),
    ("Weak cryptography", "Hash passwords with bcrypt or Argon2"),
    ("XXE", "Use a parser with external entities disabled"),
    ("Security headers missing", "Set security headers for every response"),
    ("Access check missing", "Require a login and compare the owner with the current user"),
    ("Debug exposure", "Read debug mode from the environment and return a generic error"),
    ("Login without rate limit", "Limit login attempts per client"),
    ("Session handling", "Keep the session id in an httpOnly, secure cookie"),
    ("Login without logging", "Log successful and failed logins"),
    ("SSRF", "Allow-list the scheme and host, and set a timeout"),
]

ALL_RULES = SECRET_RULES + CODE_RULES + CONTROL_RULES
