"""Find credentials in code, configuration and notes, and splice redactions into the original text.

Configuration formats (JSON, YAML, TOML, XML, dotenv, properties, ini, shell, image
descriptions, netrc, pgpass) are parsed into entries (key path, span of the value); source
code and notes give entries for assignments, keyword arguments and headers. An entry counts
if its key names a secret and its value has the shape of one. Besides, values that tell
by themselves what they are (tokens with a known prefix, private key blocks, URLs and
connection strings with a password) count under any key. Spans are reported as byte
offsets, and redactions are spliced into the original bytes, so that everything outside
of them stays as it was.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

REDACTED = "***REDACTED***"

#: Names whose value is a secret: the last words of a key, in lower case and joined (fixed values).
SECRET_NAMES = (
    "password passwd passphrase passwort passcode pass pwd secret secrets token apikey accesskey privatekey masterkey signingkey secretkey "
    "encryptionkey accountkey authkey sharedkey storagekey clientkey deploykey licensekey appkey credential credentials kennwort clave claveapi contrasena "
    "contraseña motdepasse apitoken authtoken bearer webhooksecret"
).split()
_NAMES = frozenset(SECRET_NAMES)
#: Roots of such names, what may follow them in the name, and what may stand between it and the value.
_ROOTS = ("pass", "pwd", "secret", "token", "key", "credential", "kennwort", "clave", "contrase", "bearer")
_END = re.compile(r"(?:w(?:or[dt]|d)|phrase|code|s|[_\-]?api|ña|na)?(?=[\"'`\])]{0,3}[ \t]*(?:[:=,]|is\b|[`\"']))", re.I)
#: Values that stand for a secret kept elsewhere (fixed values).
_PLACEHOLDER = re.compile(
    r"(?ix) ^$ | ^[*x•.\-_?#]+$ | \$\{ | \$\( | ^\$[A-Z_] | \{\{ | ^<.*>$ | ^%\w+%$ | ^\#\{ | ^!?(?:vault|ref|env|secret|arn|ssm|file|sm|kms|op)[:/]"
    r"| change[_-]?me | replace[_-]?(?:me|this|with) | ^(?:your|my|the|some|enter|insert|add)[_\- ] | your[_-]?(?:\w+[_-])?(?:key|token|pass|secret) | ^(?:todo|tbd|none|null|nil|undefined|true|false|example|dummy|test|secret|password|token)$"
    r"| example(?:key|token|pass|secret)? $ | EXAMPLE | redacted | placeholder | ^os\.|^process\.env|getenv|environ | xxxx+"
)
#: Prefixes and forms of issued tokens (fixed values).
_SHAPES = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"(?P<aws>(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z]))|(?P<github>gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,})|(?P<gitlab>glpat-[\w\-]{18,})|(?P<slack>xox[abeoprs]-[A-Za-z0-9\-]{10,})"
    r"|(?P<stripe>[sr]k_(?:live|test)_[A-Za-z0-9]{16,})|(?P<openai>sk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_\-]{20,})|(?P<google>AIza[\w\-]{30,})"
    r"|(?P<jwt>eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,})|(?P<npm>npm_[A-Za-z0-9]{30,})|(?P<pypi>pypi-[\w\-]{30,})|(?P<sendgrid>SG\.[\w\-]{16,}\.[\w\-]{16,})"
    r")"
)
_SHAPE_HINTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "k_test_", "sk-", "AIza", "eyJ", "npm_", "pypi-", "SG.")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?:.*?-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----|[A-Za-z0-9+/=\\\sn]*)", re.S)
_URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.\-]{1,20}://([^\s/:@'\"`<>]*):([^\s@'\"`/]{1,200}|[^\s@'\"`]{1,200}?)@(?=[A-Za-z0-9\[$.{])")
_CONNECTION = re.compile(r"(?i)(?:^|[;\"'`\s])(?:password|pwd|accountkey|sharedaccesskey|sharedsecret)\s*=\s*([^;\"'`\s]+)(?=;|[\"'`]|$)", re.M)
_AUTH = re.compile(r"(?i)\bauthorization[\"'`]?\]?\s*[:=,]\s*[\"'`]?\s*(bearer|token|basic|apikey)\s+([^\s\"'`,;]+)")
_QUOTED = re.compile(r"'''(.*?)'''|\"\"\"(.*?)\"\"\"|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`", re.S)
_JOIN = re.compile(r"[ \t]*(?:(?:\+|\.|&)[ \t]*\r?\n?[ \t]*|\\\r?\n[ \t]*)")
_JOIN_OPEN = re.compile(r"\s*[+.]?\s*")
#: Configuration formats by suffix, and by the whole name of a file (fixed values).
_CONFIG = {
    "json": "json", "json5": "json", "jsonc": "json", "ipynb": "json", "tfstate": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "config": "xml", "csproj": "xml", "plist": "xml", "xaml": "xml",
    "env": "pairs", "properties": "pairs", "conf": "pairs", "ini": "pairs", "cfg": "pairs", "cnf": "pairs", "staging": "pairs", "production": "pairs", "local": "pairs", "sh": "pairs", "bash": "pairs", "zsh": "pairs", "envrc": "pairs", "npmrc": "pairs", "pypirc": "pairs",
    "netrc": "netrc", "dockerfile": "docker",
}
_CONFIG_NAMES = {"dockerfile": "docker", "containerfile": "docker", ".netrc": "netrc", "_netrc": "netrc", ".pgpass": "pgpass", "pipfile": "toml"}


class Entry(NamedTuple):
    """A key path and the spans of its value (more than one if it is written in pieces); ``home``: which map or element it stands in."""

    path: tuple[str, ...]
    spans: tuple[tuple[int, int], ...]
    home: int = -1


class Finding(NamedTuple):
    kind: str
    key: str
    spans: tuple[tuple[int, int], ...]


#: Words before ``token`` or ``key`` with which it is no secret, and words of prose that no passphrase holds (fixed values).
_NO_SECRET = frozenset("max min num next prev previous page continuation cursor start end eos bos pad unk sep cls mask special primary foreign public sort partition".split())
_PROSE = frozenset("a an and are as at be by can enter for from has have if in is it its must not of on or please should that the this to use used was when will with you your".split())
#: Names under which any word of letters may be the secret.
_PASSWORDS = ("password", "passwd", "passphrase", "passwort", "passcode", "pass", "pwd", "kennwort", "contrasena", "contraseña", "motdepasse")


def _last_words(key: str) -> list[str]:
    words = re.findall(r"[A-Z]+(?![a-zñ])|[A-Z]?[a-zñ]+|\d+", key)
    if words and words[-1].isdigit():
        words.pop()
    return [w.lower() for w in words]


def secret_name(key: str) -> bool:
    """Whether the last words of a key name a secret: ``db_pass`` and ``apiKey`` do, ``compass``, ``token_count`` and ``max_token`` do not."""
    low = _last_words(key)
    if not low or len(low) > 1 and low[-1] in ("token", "tokens", "key", "keys") and low[-2] in _NO_SECRET:
        return False
    ends = ["".join(low[-n:]) for n in (1, 2, 3) if len(low) >= n]
    return any(e in _NAMES or e.endswith("s") and e[:-1] in _NAMES for e in ends)


def password_name(key: str) -> bool:
    """Whether a key names a password or passphrase, which may be any words."""
    low = _last_words(key)
    return bool(low) and (low[-1].removesuffix("s") in _PASSWORDS or "".join(low[-2:]) in _PASSWORDS or low[-1] == "pass")


def secret_value(value: str, words: bool = False) -> bool:
    """Whether a literal under such a name is a secret and not a placeholder, a reference, a path or prose.

    ``words``: a word of eight letters, or four words and more that are no sentence, may be one.
    """
    v = value.strip()
    if len(v) < 6 or _PLACEHOLDER.search(v):
        return False
    if "PRIVATE KEY" in v or _SHAPES.match(v):
        return True
    if "-----BEGIN" in v or re.fullmatch(r"[~.]?/?(?:[a-z_.\-]+/)+[a-z_.\-]*", v):
        return False
    if any(c.isspace() for c in v):
        parts = v.split()
        return words and len(parts) >= 4 and all(re.fullmatch(r"[\w\-]{2,16}", x) for x in parts) and not _PROSE & {x.lower() for x in parts} and not any(r in v.lower() for r in _ROOTS)
    if v.startswith(("http://", "https://")) and "@" not in v:
        return False
    digit, upper, lower = any(c.isdigit() for c in v), any(c.isupper() for c in v), any(c.islower() for c in v)
    special = any(not c.isalnum() and c not in "_-./:" for c in v)
    if digit or (special and (upper or lower)) or (upper and lower and len(v) >= 10 and not re.fullmatch(r"[A-Z]?[a-z]+(?:[A-Z][a-z]+)*", v)):
        return True
    return words and len(v) >= 8 and v.isalpha() and v.islower() and not any(r in v for r in _ROOTS) and v not in _TYPES


#: Words in the place of a password that say how it is handled (fixed values).
_TYPES = frozenset("required optional disabled enabled encrypted prompted generated inherited unchanged nonempty interactive plaintext keyring".split())


# --- configuration formats -------------------------------------------------


_FLOW = re.compile(
    r'"((?:[^"\\\n]|\\.)*)"|' + r"'((?:[^'\n]|'')*)'" + r"|([{}\[\],]|[:=](?=[\s\"'{\[]|$)|(?<=[\"'])[:=])|//[^\n]*|\#[^\n]*|([^\s,{}\[\]\"'#][^\n,{}\[\]]*?(?=\s*(?:[:=](?:[\s\"'{\[]|$)|[,}\]\n]|\s\#|\Z)))", re.M
)


def flow_entries(text: str, at: int = 0, path: tuple[str, ...] = (), whole: bool = True) -> Iterator[Entry]:
    """Scalars of nested maps and lists in brackets (JSON, YAML flow collections, TOML inline tables and arrays), or of a piece of such a text.

    ``whole`` false: only the one collection that begins at ``at``.
    """
    stack: list[tuple[str, int]] = [(p, -1) for p in path]
    key, valued, home, fresh = "", False, -1, 0
    depth = 0
    for m in _FLOW.finditer(text, at):
        mark = m.group(3)
        if mark is None:
            k = m.lastindex
            if k is None:
                continue
            if not valued and re.match(r"\s*[:=]", text[m.end() : m.end() + 40]):
                key = m.group(k)
            else:
                yield Entry((*(p for p, _ in stack), key), ((m.start(k), m.end(k)),), home)
                valued = False
        elif mark in ":=":
            valued = True
        elif mark in "{[":
            depth += 1
            fresh += 1
            stack.append((key, home))
            key, valued, home = "", False, at * 1000 + fresh
        elif mark in "}]":
            depth -= 1
            if len(stack) > len(path):
                home = stack.pop()[1]
            key, valued = "", False
            if depth <= 0 and not whole:
                return
        else:
            key, valued = "", False


_YAML_LINE = re.compile(r"([ \t]*(?:- +)*)(?:\"([^\"\n]+)\"|'([^'\n]+)'|([A-Za-z_][\w.\- /]*?))[ \t]*:(?:[ \t]+(.*))?$")
_YAML_ITEM = re.compile(r"([ \t]*)-[ \t]+(.*)$")
_YAML_TAG = re.compile(r"(?:[&!][^\s]*[ \t]+)+")


def yaml_entries(text: str) -> Iterator[Entry]:
    """Scalar values of a YAML text with their key paths, flow collections included; block scalars give one span a line."""
    stack: list[tuple[int, str]] = []
    homes: dict[int, int] = {}
    lines, at, i = text.split("\n"), 0, 0
    starts = []
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    while i < len(lines):
        line, n = lines[i].rstrip("\r"), i
        i += 1
        if line.lstrip().startswith("#"):
            continue
        m = _YAML_LINE.match(line)
        item = None if m else _YAML_ITEM.match(line)
        if not m and not item:
            continue
        depth = len(m.group(1)) if m else len(item.group(1)) + 1
        while stack and stack[-1][0] >= depth:
            stack.pop()
        homes = {d: h for d, h in homes.items() if d <= depth}
        if depth not in homes or "-" in line[:depth]:
            homes[depth] = n
        group = 5 if m else 2
        key = (m.group(2) or m.group(3) or m.group(4)) if m else ""
        path = (*(k for _, k in stack), key)
        if m:
            stack.append((depth, key))
        raw = ((m or item).group(group) or "").strip()
        if not raw:
            continue
        begin = starts[n] + (m or item).start(group) + len((m or item).group(group)) - len((m or item).group(group).lstrip())
        tag = _YAML_TAG.match(raw)
        if tag:
            raw, begin = raw[tag.end() :], begin + tag.end()
        if raw[:1] in ("|", ">") and len(raw) <= 3:
            spans = []
            while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip()) > depth - (0 if m else 1)):
                body = lines[i].strip()
                if body:
                    s = starts[i] + lines[i].index(body)
                    spans.append((s, s + len(body)))
                i += 1
            if spans:
                yield Entry(path, tuple(spans), homes[depth])
        elif raw[:1] in ("'", '"'):
            q = _QUOTED.match(text, begin)
            if q:
                yield Entry(path, ((q.start(q.lastindex), q.end(q.lastindex)),), homes[depth])
        elif raw[0] in "{[":
            yield from flow_entries(text, begin, path[:-1] if not key else path, False)
        elif raw[0] not in "&*#!":
            value = re.split(r"\s+#", raw)[0]
            pair = re.match(r"([A-Za-z_]\w*)=", value) if item else None  # an environment list: - NAME=value
            yield Entry((*path[:-1], pair.group(1)) if pair else path, ((begin + (pair.end() if pair else 0), begin + len(value)),), homes[depth])


_TOML_LINE = re.compile(r"[ \t]*(?:\[{1,2}([^\]\n]+)\]{1,2}|((?:[\w\-]+|\"[^\"\n]*\"|'[^'\n]*')(?:[ \t]*\.[ \t]*(?:[\w\-]+|\"[^\"\n]*\"|'[^'\n]*'))*)[ \t]*=[ \t]*)?", re.M)


def _toml_keys(dotted: str) -> tuple[str, ...]:
    return tuple(k.strip().strip("\"'") for k in re.findall(r"\"[^\"]*\"|'[^']*'|[^.]+", dotted))


def toml_entries(text: str) -> Iterator[Entry]:
    """Strings of a TOML text with their key paths: tables, dotted keys, multi-line strings, inline tables and arrays."""
    at, table = 0, ()
    while at < len(text):
        m = _TOML_LINE.match(text, at)
        end = m.end()
        if m.group(1) is not None:
            table = _toml_keys(m.group(1))
        elif m.group(2) is not None:
            path = (*table, *_toml_keys(m.group(2)))
            q = _QUOTED.match(text, end)
            if q:
                yield Entry(path, ((q.start(q.lastindex), q.end(q.lastindex)),))
                end = q.end()
            elif text[end : end + 1] in ("{", "["):
                for e in flow_entries(text, end, path, False):
                    yield e
                    end = max(end, e.spans[-1][1])
            elif (v := re.match(r"[^\s#]+", text[end : end + 400])) and not re.match(r"[\d+\-]|true|false|inf|nan", v.group()):
                yield Entry(path, ((end, end + v.end()),))  # not quoted: no TOML, but written so
        at = text.find("\n", end) + 1
        if not at:
            return


_PAIR = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+|-e[ \t]+|//[^\s:=]*:)?([A-Za-z_][\w.\-]*)[ \t]*[=:][ \t]*(.*)$", re.M)
_SECTION = re.compile(r"^[ \t]*\[+([^\]\n]+)\]+", re.M)


def pair_entries(text: str) -> Iterator[Entry]:
    """Values of key=value lines (dotenv, properties, ini, shell), under the name of their section; a line may go on after a backslash."""
    sections = [(m.start(), m.group(1).strip()) for m in _SECTION.finditer(text)]
    at = [s for s, _ in sections]
    for m in _PAIR.finditer(text):
        k = bisect_right(at, m.start()) - 1
        path = ((sections[k][1],) if k >= 0 else ()) + (m.group(1),)
        if m.group(2)[:1] in ("'", '"'):
            q = _QUOTED.match(text, m.start(2))
            if q:
                yield Entry(path, ((q.start(q.lastindex), q.end(q.lastindex)),))
            continue
        value, begin, spans = re.split(r"\s+[#;]", m.group(2).rstrip("\r"))[0].rstrip(), m.start(2), []
        while value.endswith("\\"):
            spans.append((begin, begin + len(value) - 1))
            line = text.find("\n", begin) + 1
            stop = text.find("\n", line) if line else -1
            rest = text[line : stop if stop >= 0 else len(text)] if line else ""
            begin, value = line + len(rest) - len(rest.lstrip()), rest.strip()
        if value:
            spans.append((begin, begin + len(value)))
        if spans:
            yield Entry(path, tuple(spans))


_DOCKER = re.compile(r"^[ \t]*(?:ENV|ARG|LABEL)[ \t]+((?:[^\n\\]|\\\r?\n|\\.)*)", re.M | re.I)
_DOCKER_PAIR = re.compile(r"([A-Za-z_][\w.\-]*)=(?:\"((?:[^\"\\]|\\.)*)\"|'([^']*)'|((?:[^\s\\\"']|\\[^\r\n])+))")


def docker_entries(text: str) -> Iterator[Entry]:
    """Values of ENV, ARG and LABEL lines of an image description, in both forms."""
    for line in _DOCKER.finditer(text):
        a, b = line.span(1)
        old = re.match(r"([A-Za-z_]\w*)[ \t]+([^\s=][^\n]*?)[ \t\r]*$", line.group(1))
        if old:
            yield Entry((old.group(1),), ((a + old.start(2), a + old.end(2)),))
            continue
        for m in _DOCKER_PAIR.finditer(text, a, b):
            yield Entry((m.group(1),), (m.span(m.lastindex),))


_XML = re.compile(r"<!--.*?-->|<!\[CDATA\[(.*?)\]\]>|<(/)?([A-Za-z_][\w:.\-]*)((?:\s+[\w:.\-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/)?>|([^<>]+)", re.S)
_XML_ATTRIBUTE = re.compile(r"([\w:.\-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def xml_entries(text: str) -> Iterator[Entry]:
    """Texts and attributes of the elements of an XML text or a piece of one, with their element paths; a ``key`` element names its next sibling."""
    stack: list[str] = []
    key = ""
    for n, m in enumerate(_XML.finditer(text)):
        if m.group(3):
            if m.group(2):
                if stack:
                    stack.pop()
                continue
            stack.append(m.group(3))
            for at in _XML_ATTRIBUTE.finditer(text, m.start(4), m.end(4)):
                yield Entry((*stack, at.group(1)), (at.span(at.lastindex),), n)
            if m.group(5):
                stack.pop()
        elif m.lastindex and (body := m.group(m.lastindex).strip()):
            s = text.index(body, m.start(m.lastindex))
            if stack and stack[-1] == "key":
                key = body
                continue
            yield Entry((*stack, key) if key else tuple(stack) or ("",), ((s, s + len(body)),))
            key = ""


def netrc_entries(text: str) -> Iterator[Entry]:
    """Passwords and accounts of a netrc file."""
    for m in re.finditer(r"(?:^|\s)(password|account)\s+(\S+)", text):
        yield Entry((m.group(1),), (m.span(2),))


def pgpass_entries(text: str) -> Iterator[Entry]:
    """The fifth field of each line host:port:database:user:password."""
    for m in re.finditer(r"^(?:(?:[^:\\\n#]|\\.)*:){4}(.+?)\r?$", text, re.M):
        yield Entry(("password",), (m.span(1),))


_NAMES_OF = ("name", "key", "id", "variable", "env")
_VALUES_OF = ("value", "val", "default", "content", "data")


def named_by_sibling(found: list[Entry], text: str) -> list[Entry]:
    """Entries under ``value`` and the like, named by the ``name`` or ``key`` beside them: {name: DB_PASSWORD, value: ...}."""
    names = {e.home: text[e.spans[0][0] : e.spans[0][1]] for e in found if e.home >= 0 and e.path[-1].lower() in _NAMES_OF}
    return [e._replace(path=(*e.path[:-1], names[e.home])) if e.home in names and e.path[-1].lower() in _VALUES_OF else e for e in found]


_PARSERS = {"json": flow_entries, "yaml": yaml_entries, "toml": toml_entries, "pairs": pair_entries, "docker": docker_entries, "xml": xml_entries, "netrc": netrc_entries, "pgpass": pgpass_entries}


def config_format(file_path: str | None) -> str | None:
    """The configuration format that a path names, or None."""
    name = (file_path or "").rsplit("/", 1)[-1].lower()
    return _CONFIG_NAMES.get(name) or _CONFIG_NAMES.get(name.split(".", 1)[0]) or _CONFIG.get(name.rsplit(".", 1)[-1])


# --- source code and notes -------------------------------------------------

_SEPARATOR = re.compile(r"[\"'`\])]{0,3}[ \t]*(?::=|=>|:[ \t]*[\w<>\[\]., |]{1,40}?[ \t]*=(?!=)|=(?!=)|:|,|is\b)?[ \t]*")


_OPEN = re.compile(r"\(\s*")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]{8,}(?=[\s;,]|$)")
_SHELL_LINE = re.compile(r"\s*(?:[$>`\-*]\s*)?(?:export\s+|set\s+|env\s+)?")


def secret_keys(text: str, low: str) -> list[tuple[int, int]]:
    """Spans of the names of secrets that may have a value behind them. ``low``: the text in lower case."""
    spans = set()
    for root in _ROOTS:
        at = low.find(root)
        while at >= 0:
            m = _END.match(text, at + len(root))
            if m:
                a = at
                while a > 0 and at - a < 80 and (text[a - 1].isalnum() or text[a - 1] in "_-"):
                    a -= 1
                if secret_name(text[a : m.end()]):
                    spans.add((a, m.end()))
            at = low.find(root, at + 1)
    return sorted(spans)


def code_entries(text: str, keys: list[tuple[int, int]]) -> Iterator[Entry]:
    """Values of assignments, keyword arguments, mapping entries, (name, value) arguments and notes."""
    for a, end in keys:
        key = text[a:end]
        sep = _SEPARATOR.match(text, end)
        at, mark = sep.end(), sep.group().strip()
        if mark.endswith(",") and mark[:1] not in ("'", '"', "`"):
            continue  # only a quoted name goes with the next argument
        join = _JOIN
        opened = _OPEN.match(text, at)
        if opened and mark.endswith("="):
            at, join = opened.end(), _JOIN_OPEN
        q = _QUOTED.match(text, at)
        if q:
            spans = []
            while q:
                spans.append((q.start(q.lastindex), q.end(q.lastindex)))
                j = join.match(text, q.end())
                q = _QUOTED.match(text, j.end()) if j and j.end() > q.end() else None
            yield Entry((key,), tuple(spans))
        elif mark.endswith("="):
            v = _BARE.match(text, at)
            if v and _SHELL_LINE.fullmatch(text[text.rfind("\n", 0, a) + 1 : a]):
                yield Entry((key,), ((v.start(), v.end()),))


def entries(text: str, file_path: str | None, low: str) -> list[Entry]:
    """Entries of a text, by the format its path names. ``low``: the text in lower case."""
    kind = config_format(file_path)
    if kind is None:
        keys = secret_keys(text, low)
        return list(code_entries(text, keys)) if keys else []
    if kind != "pgpass" and not any(root in low for root in _ROOTS):
        return []
    return named_by_sibling(list(_PARSERS[kind](text)), text)


#: Secrets in command lines: user and password of a request, and options that name a secret.
_COMMAND_USER = re.compile(r"(?:^|[\s`\"'])(?:curl|wget|http|https|xh)\b[^\n]{0,200}?\s(?:-u|--user)[= ]?[\"']?([^\s:\"']+):([^\s\"'@]+)")
_COMMAND_OPTION = re.compile(r"(?<![\w\-])--((?:[a-z]+-)*(?:password|passwd|passphrase|token|secret|api-key|access-key|secret-key))(?:=|[ ]+)(?![\-<$])[\"']?([^\s\"']{6,})")


def _basic(value: str) -> bool:
    try:
        return b":" in base64.b64decode(value, validate=True)
    except (binascii.Error, ValueError):
        return False


def find_credentials(text: str, file_path: str | None = None) -> list[Finding]:
    """Credentials of a text by place, without overlaps (the earlier and longer one stands)."""
    found: list[Finding] = []
    low = text.lower()
    if len(low) != len(text):  # a letter that grows in lower case would shift the offsets
        low = "".join(c.lower() if c.isascii() else c for c in text)
    for e in entries(text, file_path, low):
        name = e.path[-1] if secret_name(e.path[-1]) else e.path[-2] if e.path[-1].lower() in (*_VALUES_OF, "key", "string", "") and len(e.path) > 1 and secret_name(e.path[-2]) else None
        if name and secret_value("".join(text[a:b] for a, b in e.spans), password_name(name)):
            found.append(Finding("named", ".".join(p for p in e.path if p), e.spans))
    if " -u" in text or "--" in text:
        for m in _COMMAND_USER.finditer(text) if "--user" in text or " -u" in text else ():
            if secret_value(m.group(2), True):
                found.append(Finding("command", m.group(1), (m.span(2),)))
        for m in _COMMAND_OPTION.finditer(text):
            if secret_value(m.group(2), password_name(m.group(1))):
                found.append(Finding("command", m.group(1), (m.span(2),)))
    if any(h in text for h in _SHAPE_HINTS):
        for m in _SHAPES.finditer(text):
            if not _PLACEHOLDER.search(m.group()) and any(c.isdigit() for c in m.group()):
                found.append(Finding(m.lastgroup or "token", "", ((m.start(), m.end()),)))
    if "-----BEGIN" in text:
        found += [Finding("private_key", "", ((m.start(), m.end()),)) for m in _PEM.finditer(text)]
    if "://" in text:
        for m in _URL.finditer(text):
            if not _PLACEHOLDER.search(m.group(2)) and m.group(2).lower() not in ("pass", "password", "pwd", "passwd", "secret"):
                found.append(Finding("url_password", "", ((m.start(2), m.end(2)),)))
    if "password=" in low or "pwd=" in low or "accountkey=" in low or "sharedaccesskey=" in low or "sharedsecret=" in low:
        for m in _CONNECTION.finditer(text):
            if ";" in text[max(0, m.start() - 200) : m.end() + 1] and not _PLACEHOLDER.search(m.group(1)):
                found.append(Finding("connection_string", "", ((m.start(1), m.end(1)),)))
    if "authorization" in low:
        for m in _AUTH.finditer(text):
            v = m.group(2)
            ok = _basic(v) if m.group(1).lower() == "basic" else secret_value(v)
            if ok and not _PLACEHOLDER.search(v):
                found.append(Finding("header", m.group(1), ((m.start(2), m.end(2)),)))
    found.sort(key=lambda f: (f.spans[0][0], -f.spans[-1][1]))
    out: list[Finding] = []
    end = -1
    for f in found:
        if f.spans[0][0] >= end:
            out.append(f)
            end = f.spans[-1][1]
    return out


def byte_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of characters as spans of UTF-8 bytes (``spans`` in order, without overlaps)."""
    out, at, byte = [], 0, 0
    for a, b in spans:
        byte += len(text[at:a].encode("utf-8", "surrogatepass"))
        end = byte + len(text[a:b].encode("utf-8", "surrogatepass"))
        out.append((byte, end))
        at, byte = b, end
    return out


def redact(text: str, found: list[Finding]) -> str:
    """Blank the findings by splicing the original bytes; line ends inside of them stay, so that no line moves."""
    if not found:
        return text
    raw, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in byte_spans(text, sorted({s for f in found for s in f.spans})):
        parts += [raw[at:a], re.sub(rb"[^\r\n]+", REDACTED.encode(), raw[a:b])]
        at = b
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


_FIELDS = "kind string, key string, line_no int, byte_start int, byte_end int"
_FINDINGS = f"array<struct<{_FIELDS.replace(' ', ':').replace(',:', ',')}>>"


def _row(text: str, found: list[Finding]) -> list[dict]:
    rows = []
    for f in found:
        a, b = f.spans[0][0], f.spans[-1][1]
        start, end = byte_spans(text, [(a, b)])[0]
        rows.append({"kind": f.kind, "key": f.key, "line_no": text.count("\n", 0, a) + 1, "byte_start": start, "byte_end": end})
    return rows


def scan_credentials(chunks: DataFrame) -> DataFrame:
    """(id, kind, key, line_no, byte_start, byte_end): a row per credential and row of ``chunks``; bytes of the content in UTF-8.

    chunks: (id, file_path, content). Null or empty contents give no rows; a null path is read as code;
    repeated rows repeat their findings; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, path, text in zip(pdf["id"], pdf["file_path"], pdf["content"], strict=True):
                found = find_credentials(text, path)
                out += [(i, *r.values()) for r in _row(text, found)]
            yield pd.DataFrame(out, columns=["id", *(c.split()[0] for c in _FIELDS.split(", "))])

    src = chunks.where(F.col("content").isNotNull()).select("id", "file_path", "content")
    return src.mapInPandas(run, f"id string, {_FIELDS}")


def redact_credentials(chunks: DataFrame) -> DataFrame:
    """``chunks`` with (redacted, findings) added: the content with credentials blanked, null for a null content."""

    @F.pandas_udf(f"redacted string, findings {_FINDINGS}")
    def run(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for p, text in zip(path, content, strict=True):
            found = find_credentials(text, p) if text else []
            out.append((text if text is None else redact(text, found), _row(text, found) if found else []))
        return pd.DataFrame(out, columns=["redacted", "findings"])

    return chunks.withColumn("_r", run(F.col("file_path"), F.col("content"))).select("*", F.col("_r.redacted").alias("redacted"), F.col("_r.findings").alias("findings")).drop("_r")
