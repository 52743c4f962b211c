"""Fixed catalogues: scan rules, file kinds, limits, report texts.

Everything here is data. Adding a rule means adding a ``Rule`` record; the scan
plan is generated from the list.
"""

from __future__ import annotations

from dataclasses import dataclass

# Unicode white space as the rules understand it. Java's \s under (?U) lacks the
# four separators U+001C..U+001F, so they are always added.
WS_CLASS = r"\s\x1c-\x1f"
W = rf"[{WS_CLASS}]*"
WS1 = rf"[{WS_CLASS}]+"
QUOTE = r"""['"]"""
ASSIGN = rf"""[{WS_CLASS}'"=:]+"""
NOT_SPACE_QUOTE_AT = rf"""[^{WS_CLASS}'"@]+"""
DB_CALL = r"(?:execute|cursor\.execute|query|raw_query)"
TEMPLATED = rf"(?:f{QUOTE}|{QUOTE}{W}\+)"  # an f-string, or a quote followed by +


@dataclass(frozen=True)
class Rule:
    """One detection rule.

    ``needles`` are literals of which at least one must occur in the text for the
    pattern to have any chance (lower-case unless ``cased``). ``starts`` lists the
    letters a match can begin with. Both only save regex work, they never decide.
    """

    id: int
    type: str
    severity: str
    confidence: str
    pattern: str
    starts: str
    needles: tuple[str, ...]
    description: str
    cased: bool = False
    also: str = ""  # a literal that every match contains besides its needle
    # The same language written without nested backtracking, where the pattern has some:
    # a run that cannot contain its own terminator is taken whole or not at all.
    linear: str = ""
    # Text that begins like a match and is none, taken whole so that it is read once. The
    # regex then has two groups: such text, and matches.
    skips: str = ""

    @property
    def regex(self) -> str:
        body = self.linear or self.pattern
        if self.skips:
            body = rf"({self.skips})|({body})"
        if self.cased:
            return rf"(?=[{self.starts}])(?U)(?:{body})"
        # A plain character class is a table lookup, far cheaper than case folding.
        both = self.starts + self.starts.upper() + ("\u017f" if "s" in self.starts else "")
        return rf"(?=[{both}])(?iU)(?:{body})"


# Rule types, severities, confidences and patterns. The order counts:
# the first six are the secret rules and compete for a line in this order. Java forces two
# changes only: its white-space class (WS_CLASS), and \z where $ would also match before a
# line end. The linear forms of rules 4 and 7 are own ones, tested against the patterns.
RULES: tuple[Rule, ...] = (
    Rule(
        0, "hardcoded_api_key", "critical", "high",
        rf"(?:sk-|pk-)[a-zA-Z0-9]{{20,}}|AIza[0-9A-Za-z\-_]{{35}}"
        rf"|api[_-]?key{ASSIGN}{QUOTE}[a-zA-Z0-9_\-]{{16,}}{QUOTE}",
        "spa",
        ("sk-", "pk-", "aiza", "apikey", "api_key", "api-key"),
        "An API key is written into the source; every copy of the code exposes it.",
    ),
    Rule(
        1, "hardcoded_aws_key", "critical", "high",
        rf"AKIA[0-9A-Z]{{16}}|aws_access_key_id{ASSIGN}{QUOTE}[A-Z0-9]{{16,}}{QUOTE}",
        "Aa",
        ("AKIA", "aws_access_key_id"),
        "An AWS access key id is written into the source; rotate it now.",
        cased=True,
    ),
    Rule(
        2, "hardcoded_password", "high", "high",
        rf"""(?:password|passwd|pwd|secret|token){W}[=:]{W}{QUOTE}[^'"$\n]{{6,}}{QUOTE}""",
        "pst",
        ("password", "passwd", "pwd", "secret", "token"),
        "A password, secret or token is assigned as a literal.",
    ),
    Rule(
        3, "hardcoded_jwt", "critical", "high",
        rf"bearer{WS1}[a-zA-Z0-9\-_.]{{20,}}|eyJ[a-zA-Z0-9\-_.]{{20,}}",
        "be",
        ("bearer", "eyj"),
        "A bearer or JSON web token is written into the source.",
    ),
    Rule(
        4, "hardcoded_db_url", "critical", "high",
        rf"(?:postgresql?|mysql|mongodb|redis)://{NOT_SPACE_QUOTE_AT}:{NOT_SPACE_QUOTE_AT}@",
        "pmr",
        ("postgresq", "mysql://", "mongodb://", "redis://"),
        "A database address carries its user name and password.",
        also="@",
        # The first look-ahead is a table lookup per character and refuses most runs.
        linear=rf"""(?:postgresql?|mysql|mongodb|redis)://(?-iU:(?=[^@'"\n ]*+@))"""
        rf"(?={NOT_SPACE_QUOTE_AT}?:{NOT_SPACE_QUOTE_AT}){NOT_SPACE_QUOTE_AT}+@",
        # Of a run that does not end with @, no later part can be a match either.
        skips=rf"""(?:postgresql?|mysql|mongodb|redis)://[^{WS_CLASS}'"@]*+(?!@)""",
    ),
    Rule(
        5, "hardcoded_private_key", "critical", "high",
        rf"-----BEGIN{WS1}(?:RSA|EC|DSA|OPENSSH){WS1}PRIVATE{WS1}KEY-----",
        "-",
        ("-----BEGIN",),
        "A private key block sits in the source.",
        cased=True,
    ),
    Rule(
        6, "sql_injection_concat", "critical", "high",
        rf"{DB_CALL}{W}\({W}{TEMPLATED}",
        "ecqr",
        ("execute", "query"),
        "A query text is glued together from parts at run time.",
    ),
    Rule(
        7, "sql_injection_format", "critical", "high",
        rf"""{DB_CALL}{W}\({W}{QUOTE}[^'"]*%[sd][^'"]*{QUOTE}{W}%(?!{W}{QUOTE})""",
        "ecqr",
        ("execute", "query"),
        "A query text is filled in with the % operator instead of bound parameters.",
        also="%",
        linear=rf"""{DB_CALL}{W}\({W}{QUOTE}(?=[^'"]*?%[sd])[^'"]*+{QUOTE}{W}%(?!{W}{QUOTE})""",
    ),
    Rule(
        8, "command_injection", "critical", "high",
        rf"(?:os\.system|subprocess\.(?:call|popen|run)|exec){W}\([^)]{{0,200}}?{TEMPLATED}",
        "ose",
        ("os.system", "subprocess.", "exec"),
        "A shell or process command is assembled from text at run time.",
    ),
    Rule(
        9, "eval_usage", "high", "high",
        rf"\beval{W}\(",
        "e",
        ("eval",),
        "eval() runs whatever text it is handed.",
    ),
    Rule(
        10, "path_traversal", "high", "medium",
        rf"(?:open|read_text|write_text){W}\({W}{TEMPLATED}",
        "orw",
        ("open", "read_text", "write_text"),
        "A file path is assembled from text and may leave its folder.",
    ),
    Rule(
        11, "weak_crypto", "medium", "high",
        rf"hashlib\.md5|hashlib\.sha1|Crypt::MD5|MessageDigest\.getInstance{W}\({W}{QUOTE}MD5",
        "hcm",
        ("hashlib.", "crypt::md5", "messagedigest.getinstance"),
        "MD5 or SHA-1 is used; neither resists collisions.",
    ),
    Rule(
        12, "weak_encryption", "medium", "high",
        rf"\.getInstance{W}\({W}{QUOTE}DES|\.getInstance{W}\({W}{QUOTE}RC4|Fernet{W}\(|AES\.new",
        ".fa",
        (".getinstance", "fernet", "aes.new"),
        "A cipher set-up that deserves a review (DES, RC4, Fernet or raw AES).",
    ),
    Rule(
        13, "insecure_http", "low", "medium",
        rf"""http://[^{WS_CLASS}'"{{}}/:?#]+\.(?:com|ro|org|net|io)""",
        "h",
        ("http://",),
        "A plain HTTP address; the traffic can be read and changed on the way.",
    ),
    Rule(
        14, "hardcoded_debug", "high", "high",
        rf"debug{W}={W}True|DEBUG{W}={W}True|app\.run\([^()]*debug{W}={W}True",
        "da",
        ("debug",),
        "Debug mode is switched on in code and would reach production.",
    ),
)

LAST_SECRET_RULE = 5
SQL_CONCAT_RULE = 6
SQL_FORMAT_RULE = 7
EVAL_RULE = 9
HTTP_RULE = 13

# Text before a plain HTTP address that marks it as a namespace name.
_NS_END = rf"""{W}['"#]?\z"""
NAMESPACE_CONTEXTS: tuple[str, ...] = (
    rf"(?iU)\b\w+(?:Ns|Namespace|Schema|Xmlns){W}[=:]{_NS_END}",
    r"(?U)\bXNamespace\b|\bXmlSerializerNamespaces\b",
    rf"(?iU)\bxmlns[:\w]*{W}={_NS_END}",
    rf"(?iU)\btargetNamespace{W}={_NS_END}",
    rf"(?iU)\bAction{W}={_NS_END}",
    rf"""(?iU)SOAPAction['"{WS_CLASS}]*[:=]{_NS_END}""",
    r"(?iU)AddNamespace|AppendNamespace|NamespaceManager|DefineNamespace|RegisterNamespace",
)

# Those that may stand anywhere before the address; the others end where it begins, and
# hold no slash, so that they never reach back over an address before.
NAMESPACE_ANYWHERE = tuple(p for p in NAMESPACE_CONTEXTS if not p.endswith(r"\z"))
NAMESPACE_RIGHT_BEFORE = tuple(p for p in NAMESPACE_CONTEXTS if p.endswith(r"\z"))

# Hosts that only ever name XML vocabularies, with their subdomains.
NAMESPACE_HOSTS: tuple[str, ...] = (
    "w3.org", "xmlsoap.org", "schemas.xmlsoap.org", "purl.org", "openxmlformats.org", "tempuri.org", "www.w3.org",
)

# Batch files, and batch words right before "eval".
BATCH_FILE = r"\.(?:bat|cmd)\z"
BATCH_TOKEN = rf"(?iU)(?:if{WS1}defined|\bset){W}\z"

# Admission and archive limits.
DEFAULT_FILENAME = "input.py"
MAX_CODE_CHARS = 100_000
MAX_FILENAME_CHARS = 255
MAX_FINDINGS_PER_SCAN = 200
MAX_ARCHIVE_BYTES = 5 * 1024 * 1024
MAX_ARCHIVE_ENTRIES = 300
MAX_ARCHIVE_EXPANDED = 15 * 1024 * 1024
MAX_ENTRY_BYTES = 1024 * 1024
MAX_FINDINGS_PER_ENTRY = 100
MAX_FINDINGS_PER_ARCHIVE = 500
BINARY_PROBE_BYTES = 8192

# What counts as source code inside an archive.
CODE_SUFFIXES: tuple[str, ...] = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".html", ".htm", ".java", ".go", ".rb", ".php", ".sql", ".json", ".yml",
    ".yaml", ".env", ".sh", ".bash", ".cs", ".c", ".cpp", ".h", ".kt", ".swift", ".rs", ".tf", ".vue", ".svelte",
)
BARE_NAMES: tuple[str, ...] = (".env", "dockerfile", "makefile", "procfile")

# Plan limits, and per-minute limits of the routes.
PLAN_PER_MINUTE = {"free": 30, "pro": 300}
PLAN_PER_DAY = {"free": 50, "pro": 500}
DEFAULT_PLAN = "free"
LEGACY_EMAIL = "legacy@local"
LEGACY_PER_MINUTE = 300
ANON_PER_MINUTE = 30
ADDRESS_ROUTE_PER_MINUTE = {"stats": 10, "history": 60, "keys": 10}
MAX_EMAIL_CHARS = 254
KEY_PREFIX_CHARS = 8
UNSALTED_ADDRESS = "pepper-unset"

# Severities in report wording.
SEVERITIES: tuple[str, ...] = ("critical", "high", "medium", "low")
SEVERITY_LABELS = {
    "critical": "🔴 CRITICAL",
    "high": "🟠 HIGH",
    "medium": "🟡 MEDIUM",
    "low": "🔵 LOW",
}

DEFAULT_TEMPLATE = (
    "Something here deserves a look",
    "A pattern on this line often points to a weakness. Read the line and judge it.",
    "Look at the marked line, say whether it is exploitable, and suggest a safer form.",
)

# type -> (title, explanation, fix prompt)
TEMPLATES: dict[str, tuple[str, str, str]] = {
    "hardcoded_api_key": (
        "API key in the source",
        "A service key is stored as plain text. Whoever reads the code can spend on your account.",
        "Load this key from the environment, keep the env file out of git, and show me each step.",
    ),
    "hardcoded_aws_key": (
        "AWS key in the source",
        "An AWS access key is stored as plain text and opens your cloud account to any reader.",
        "Move this AWS key to a credentials profile, and walk me through rotating the old one.",
    ),
    "hardcoded_password": (
        "Password or secret in the source",
        "A literal that looks like a password is assigned here and travels with every copy.",
        "Read this secret from a secret store or the environment and change the code for it.",
    ),
    "hardcoded_jwt": (
        "Access token in the source",
        "A token is stored as plain text. Until it expires, a reader can act as its owner.",
        "Obtain this token at sign-in and keep it out of the code; rewrite the call that way.",
    ),
    "hardcoded_db_url": (
        "Database credentials in an address",
        "This connection address names the user and the password of a database.",
        "Build this address from environment settings so that no credential stays in the code.",
    ),
    "hardcoded_private_key": (
        "Private key in the source",
        "A private key block is stored with the code. Its holder can impersonate its owner.",
        "Move this key into a key store, restrict access, and explain how to replace the key.",
    ),
    "sql_injection_concat": (
        "SQL text glued together",
        "The statement is assembled from pieces, so crafted input can change what it does.",
        "Turn this statement into one with bound parameters and show the call.",
    ),
    "sql_injection_format": (
        "SQL text filled by formatting",
        "Values are formatted into the statement, so crafted input can change what it does.",
        "Replace the formatting with bound parameters for my database driver.",
    ),
    "command_injection": (
        "Command line built from text",
        "A system command is assembled at run time; crafted input can run other commands.",
        "Call the program with an argument list and no shell, and show the new call.",
    ),
    "eval_usage": (
        "eval() on text",
        "eval() executes any expression it receives, including hostile ones.",
        "Replace eval() by literal parsing or by a table of allowed operations.",
    ),
    "path_traversal": (
        "File path built from text",
        "The path is assembled at run time and may point outside the intended folder.",
        "Resolve this path against a fixed base folder and reject anything outside it.",
    ),
    "weak_crypto": (
        "Outdated hash function",
        "MD5 and SHA-1 collisions can be made on demand, so they protect nothing.",
        "Switch this to SHA-256, or to a password hash if it guards passwords.",
    ),
    "weak_encryption": (
        "Cipher that needs a review",
        "Old ciphers such as DES or RC4 fall quickly, and raw set-ups are easy to get wrong.",
        "Use authenticated encryption (AES-GCM) here and show the key handling.",
    ),
    "insecure_http": (
        "Address without encryption",
        "Data sent to a plain HTTP address can be read and changed on the way.",
        "Change this address to https and tell me what to do if the host lacks it.",
    ),
    "hardcoded_debug": (
        "Debug mode left on",
        "An active debugger lets a visitor run code on the server.",
        "Take the debug switch from the environment, off by default, and bind to localhost.",
    ),
}
