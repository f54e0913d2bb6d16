"""Redaction rules and their translation to Java regular expressions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One redaction rule.

    ``pattern`` and ``replacement`` are in RE2 notation (``${1}`` for a group).
    A rule with ``drop`` removes the whole row instead of rewriting it.
    ``needs`` speeds a rule up: text that holds none of these strings cannot
    match. With ``any_case`` they are looked for in lower-cased text.
    ``only_if`` is a pattern found in all matching text that is cheaper to look
    for. ``ends_with`` names a character every match ends with. ``starts`` are
    patterns that consume text from each place on where a match may begin, so that
    a rule with an open-ended repeat is not tried from every one of them. ``ahead``
    is a piece of the pattern and what must follow it in all matching text; it spares
    a backtracking engine from cutting a long run in two in every way. ``by_run`` is a
    pattern and a replacement with the same result that look at each run of characters once,
    from its beginning, where several matches could begin in a run and end only behind it.
    """

    name: str
    pattern: str
    replacement: str = "<REDACTED>"
    drop: bool = False
    needs: tuple[str, ...] = ()
    any_case: bool = False
    only_if: str = ""
    ends_with: str = ""
    starts: tuple[str, ...] = ()
    ahead: tuple[str, str] = ()
    by_run: tuple[str, str] = ()


# What follows a variable's name in all matching text, up to the first character of its value.
_ASSIGNED = r"""+(?=[A-Z_]*+\s*+=\s*+['"]?+[^'"\s])"""
# A signed token begins at the first boundary before its prefix in a run of token characters: if
# that place fails, so do all later ones of the run, as only what follows the run decides.
_JWT_BY_RUN = (
    r"(?<![A-Za-z0-9_-])((?:(?!\beyJ)[A-Za-z0-9_-])*+)"
    r"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+\b"
)
# In a run without blanks and quotes the first assignment with a value inside of the run counts, if a
# blank follows the run; otherwise only a name at its very end can be given a value behind it.
_NAMES = r"\b(?:PASSWORD|SECRET|TOKEN|API_KEY)"
_INLINE_BY_RUN = (
    r"""(?<![^'"\s])("""
    rf"""(?=[^'"\s]++['"]?\s)(?:(?!{_NAMES}=[^'"\s])[^'"\s])*+{_NAMES}="""
    rf"""|(?:(?!{_NAMES}=?(?![^'"\s]))[^'"\s])*+{_NAMES}\s*+=\s*+['"]?+"""
    r""")[^'"\s]++(['"]?\s)"""
)


# The built-in rules, in the order in which they apply.
RULES: tuple[Rule, ...] = (
    Rule("password-flag-quoted-double", r'(--password[=\s]+)"([^"]+)"', '${1}"<REDACTED>"', needs=("--password",)),
    Rule("password-flag-quoted-single", r"(--password[=\s]+)'([^']+)'", "${1}'<REDACTED>'", needs=("--password",)),
    Rule("password-flag-unquoted", r"""(--password[=\s]+)([^'"'\s]+)""", "${1}<REDACTED>", needs=("--password",)),
    Rule("passwd-flag", r"""(--passwd[=\s]+)(['"]?)([^'"'\s]+)(['"]?)""", "${1}${2}<REDACTED>${4}", needs=("--passwd",)),
    Rule("mysql-password", r"""(\s-p)(['"]?)([^'"'\s-][^'"'\s]*)(['"]?)""", "${1}${2}<REDACTED>${4}", needs=("-p",)),
    Rule("token-flag", r"""(--token[=\s]+['"]?)([^'"'\s]+)(['"]?)""", "${1}<REDACTED>${3}", needs=("--token",)),
    Rule("api-key-flag", r"""(--api-key[=\s]+['"]?)([^'"'\s]+)(['"]?)""", "${1}<REDACTED>${3}", needs=("--api-key",)),
    Rule("secret-flag", r"""(--secret[=\s]+['"]?)([^'"'\s]+)(['"]?)""", "${1}<REDACTED>${3}", needs=("--secret",)),
    Rule("api-key-export", r"""(export\s+[A-Z_]*API[_]?KEY\s*=\s*['"]?)([^'"'\s]+)(['"]?)""", "${1}<REDACTED>${3}", needs=("export",), ahead=(r"export\s+", _ASSIGNED)),
    Rule("secret-export", r"""(export\s+[A-Z_]*SECRET[A-Z_]*\s*=\s*['"]?)([^'"'\s]+)(['"]?)""", "${1}<REDACTED>${3}", needs=("export",), ahead=(r"export\s+", _ASSIGNED)),
    Rule("password-export", r"""(export\s+[A-Z_]*PASS(?:WORD)?[A-Z_]*\s*=\s*['"]?)([^'"'\s]+)(['"]?)""", "${1}<REDACTED>${3}", needs=("export",), ahead=(r"export\s+", _ASSIGNED)),
    Rule("token-export", r"""(export\s+[A-Z_]*TOKEN\s*=\s*['"]?)([^'"'\s]+)(['"]?)""", "${1}<REDACTED>${3}", needs=("export",), ahead=(r"export\s+", _ASSIGNED)),
    Rule("credentials-export", r"""(export\s+[A-Z_]*CRED(?:ENTIAL)?S?[A-Z_]*\s*=\s*['"]?)([^'"'\s]+)(['"]?)""", "${1}<REDACTED>${3}", needs=("export",), ahead=(r"export\s+", _ASSIGNED)),
    Rule("aws-access-key-id", r"""(AWS_ACCESS_KEY_ID\s*=\s*['"]?)([A-Z0-9]{20})(['"]?)""", "${1}<REDACTED>${3}", needs=("AWS_ACCESS_KEY_ID",)),
    Rule("aws-secret-key", r"""(AWS_SECRET_ACCESS_KEY\s*=\s*['"]?)([A-Za-z0-9/+=]{40})(['"]?)""", "${1}<REDACTED>${3}", needs=("AWS_SECRET_ACCESS_KEY",)),
    Rule("aws-session-token", r"""(AWS_SESSION_TOKEN\s*=\s*['"]?)([^'"'\s]+)(['"]?)""", "${1}<REDACTED>${3}", needs=("AWS_SESSION_TOKEN",)),
    Rule("connection-string-password", r"(://[^:]+:)([^@]+)(@)", "${1}<REDACTED>${3}", needs=("://",), ends_with="@"),
    Rule("bearer-token", r"""(Authorization:\s*Bearer\s+)([^\s'"]+)""", "${1}<REDACTED>", needs=("Authorization:",)),
    Rule("basic-auth", r"""(Authorization:\s*Basic\s+)([^\s'"]+)""", "${1}<REDACTED>", needs=("Authorization:",)),
    Rule("auth-header-h-flag", r"""(-H\s+['"]?Authorization:\s*(?:Bearer|Basic)\s+)([^'"'\s]+)(['"]?)""", "${1}<REDACTED>${3}", needs=("Authorization:",)),
    Rule("private-key", r"-----BEGIN\s+(?:RSA\s+|EC\s+|OPENSSH\s+|ENCRYPTED\s+|DSA\s+)?PRIVATE\s+KEY-----", "", drop=True, needs=("-----BEGIN",)),
    Rule("pgp-private-key", r"-----BEGIN\s+PGP\s+PRIVATE\s+KEY\s+BLOCK-----", "", drop=True, needs=("-----BEGIN",)),
    Rule("github-token", r"(gh[ps]_[A-Za-z0-9]{36,})", needs=("ghp_", "ghs_")),
    Rule("github-pat", r"(github_pat_[A-Za-z0-9_]{22,})", needs=("github_pat_",)),
    Rule("jwt-token", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "<REDACTED_JWT>", needs=(".eyJ",), by_run=(_JWT_BY_RUN, "${1}<REDACTED_JWT>")),
    Rule("slack-bot-token", r"xoxb-[0-9]+-[0-9]+-[A-Za-z0-9]+", needs=("xoxb-",)),
    Rule("slack-user-token", r"xoxp-[0-9]+-[0-9]+-[0-9]+-[A-Za-z0-9]+", needs=("xoxp-",)),
    Rule("slack-app-token", r"xapp-[0-9]+-[A-Za-z0-9]+-[0-9]+-[A-Za-z0-9]+", needs=("xapp-",)),
    Rule("slack-refresh-token", r"xoxr-[0-9]+-[A-Za-z0-9]+", needs=("xoxr-",)),
    Rule("slack-webhook", r"https://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+", "<REDACTED_SLACK_WEBHOOK>", needs=("https://hooks.slack.com/services/T",)),
    Rule("discord-webhook", r"https://discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+", "<REDACTED_DISCORD_WEBHOOK>", needs=(".com/api/webhooks/",)),
    Rule("generic-webhook-secret", r"(https?://[^/]+/webhooks?/)[A-Za-z0-9_-]{20,}", "${1}<REDACTED>", needs=("/webhook",)),
    Rule("gcp-api-key", r"AIza[A-Za-z0-9_-]{35}", needs=("AIza",)),
    Rule("google-oauth", r"ya29\.[A-Za-z0-9_-]+", needs=("ya29.",)),
    Rule("azure-storage-key", r"(?i)(AccountKey\s*=\s*)([A-Za-z0-9+/=]{88})", "${1}<REDACTED>", needs=("accountkey",), any_case=True),
    Rule("azure-connection-string", r"(?i)(DefaultEndpointsProtocol=https?;AccountName=[^;]+;AccountKey=)([A-Za-z0-9+/=]+)", "${1}<REDACTED>", needs=(";accountkey=",), any_case=True),
    Rule("azure-sas-token", r"(\?|&)(sig|sv|ss|srt|sp|se|st|spr|sr)=[^&\s]+", "${1}${2}=<REDACTED>", needs=("?s", "&s")),
    Rule("digitalocean-token", r"dop_v1_[a-f0-9]{64}", needs=("dop_v1_",)),
    Rule("digitalocean-oauth", r"doo_v1_[a-f0-9]{64}", needs=("doo_v1_",)),
    Rule("stripe-secret-key", r"sk_live_[A-Za-z0-9]{24,}", needs=("sk_live_",)),
    Rule("stripe-test-key", r"sk_test_[A-Za-z0-9]{24,}", needs=("sk_test_",)),
    Rule("stripe-restricted-key", r"rk_live_[A-Za-z0-9]{24,}", needs=("rk_live_",)),
    Rule("twilio-account-sid", r"AC[a-f0-9]{32}", needs=("AC",)),
    Rule("twilio-api-key", r"SK[a-f0-9]{32}", needs=("SK",)),
    Rule("sendgrid-api-key", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", needs=("SG.",)),
    Rule("mailgun-api-key", r"key-[a-f0-9]{32}", needs=("key-",)),
    Rule("npm-token", r"npm_[A-Za-z0-9]{36,}", needs=("npm_",)),
    Rule("pypi-token", r"pypi-[A-Za-z0-9_-]{50,}", needs=("pypi-",)),
    Rule("heroku-api-key", r"""(?i)(HEROKU_API_KEY\s*=\s*['"]?)([a-f0-9-]{36})(['"]?)""", "${1}<REDACTED>${3}", needs=("heroku_api_key",), any_case=True),
    Rule("shopify-access-token", r"shpat_[a-f0-9]{32}", needs=("shpat_",)),
    Rule("shopify-shared-secret", r"shpss_[a-f0-9]{32}", needs=("shpss_",)),
    Rule("square-access-token", r"sq0atp-[A-Za-z0-9_-]{22}", needs=("sq0atp-",)),
    Rule("square-oauth-secret", r"sq0csp-[A-Za-z0-9_-]{43}", needs=("sq0csp-",)),
    Rule("datadog-api-key", r"""(?i)(DD_API_KEY\s*=\s*['"]?)([a-f0-9]{32})(['"]?)""", "${1}<REDACTED>${3}", needs=("dd_api_key",), any_case=True),
    Rule("newrelic-api-key", r"NRAK-[A-Z0-9]{27}", needs=("NRAK-",)),
    Rule("vault-token", r"""(?i)(VAULT_TOKEN\s*=\s*['"]?)([shrs]\.[A-Za-z0-9_-]+)(['"]?)""", "${1}<REDACTED>${3}", needs=("vault_token",), any_case=True),
    Rule("mongodb-connection-string", r"mongodb(?:\+srv)?://[^:]+:([^@]+)@", "mongodb://[user]:<REDACTED>@", needs=("mongodb",), ends_with="@"),
    Rule("generic-secret-assignment", r"""(?i)((?:secret|password|passwd|pwd|token|api_key|apikey|auth)[_-]?\w{0,20}\s{0,3}[=:]\s{0,3}['"]?)([^'"'\s]{8,})(['"]?)""", "${1}<REDACTED>${3}", needs=("ecret", "word", "wd", "token", "api_key", "apikey", "auth"), any_case=True),
    Rule("inline-secret-var", r"""(\b(?:PASSWORD|SECRET|TOKEN|API_KEY)\s*=\s*['"]?)([^'"'\s]+)(['"]?\s)""", "${1}<REDACTED>${3}", needs=("PASSWORD", "SECRET", "TOKEN", "API_KEY"), by_run=(_INLINE_BY_RUN, "${1}<REDACTED>${2}")),
    Rule("curl-password-data", r"""(-d\s+['"]?[^'"]*(?:password|passwd|secret|token)['"]*\s*[=:]\s*['"]?)([^'"&\s]+)(['"]?)""", "${1}<REDACTED>${3}", needs=("-d",), only_if=r"""(?:password|passwd|secret|token)['"]*\s*[=:]""", starts=(r"""-d\s[^'"]*+""", r"""(?<!\x{E000})-d\s+(?=['"])""")),
    Rule("docker-secret-env", r"(-e\s+[A-Z_]*(?:PASSWORD|SECRET|TOKEN|API_KEY)[A-Z_]*=)([^\s]+)", "${1}<REDACTED>", needs=("PASSWORD", "SECRET", "TOKEN", "API_KEY"), ahead=(r"-e\s+", r"+(?=[A-Z_]*+=[^\s])")),
    Rule("kubectl-secret", r"(--from-literal=[A-Za-z_-]*(?:password|secret|token|key)[A-Za-z_-]*=)([^\s]+)", "${1}<REDACTED>", needs=("--from-literal=",), ahead=("--from-literal=", r"(?=[A-Za-z_-]*+=[^\s])")),
)

# Where RE2 and Java differ. RE2's \s has no vertical tab, its \b
# and \w know ASCII only, and its (?i) also folds the long s and the Kelvin sign.
RE2_SPACE = r"\t\n\f\r "
RE2_WORD = "0-9A-Za-z_"
FOLDED = {"s": chr(0x17F), "k": chr(0x212A)}


def _any_case(ch: str) -> str:
    low = ch.lower()
    return f"{low}{low.upper()}{FOLDED.get(low, '')}"


def java_pattern(pattern: str) -> str:
    """The Java regular expression that matches what ``pattern`` matches in RE2."""
    fold = pattern.startswith("(?i)")
    if fold:
        pattern = pattern[4:]
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i : i + 2]
            i += 2
            if pair == r"\s":
                out.append(RE2_SPACE if in_class else f"[{RE2_SPACE}]")
            elif pair == r"\w":
                word = RE2_WORD + ("".join(FOLDED.values()) if fold else "")
                out.append(word if in_class else f"[{word}]")
            elif pair == r"\b":
                word = f"[{RE2_WORD}]"
                out.append(f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")
            else:
                out.append(pair)
            continue
        if in_class and pattern[i + 1 : i + 2] == "-" and pattern[i + 2 : i + 3] not in ("", "]"):
            low, high = ch, pattern[i + 2]
            i += 3
            out.append(f"{low}-{high}")
            if fold and low.isalpha():
                letters = [chr(c) for c in range(ord(low), ord(high) + 1)]
                out.append(f"{low.swapcase()}-{high.swapcase()}")
                out.extend(FOLDED[c.lower()] for c in letters if c.lower() in FOLDED)
            continue
        i += 1
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        elif fold and ch.isascii() and ch.isalpha():
            out.append(_any_case(ch) if in_class else f"[{_any_case(ch)}]")
            continue
        out.append(ch)
    return "".join(out)


def rule_pattern(rule: Rule) -> str:
    """The Java regular expression of a rule."""
    pattern = rule.pattern
    if rule.ahead:
        place, follows = rule.ahead
        pattern = pattern.replace(place, place + follows, 1)
    return java_pattern(pattern)


def java_replacement(replacement: str) -> str:
    """``${1}`` is a named group in Java; numbered ones are written ``$1``."""
    out = replacement.replace("\\", "\\\\")
    for group in range(1, 10):
        out = out.replace(f"${{{group}}}", f"${group}")
    return out
