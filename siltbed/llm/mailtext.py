"""The body of a raw e-mail message as a reader sees it.

Transfer encodings are undone, HTML is shown as text, quoted lines lose their marks; headers, attachments, greetings,
signatures, disclaimers, list footers and the lines that introduce a quotation are left out. Everything works on
damaged messages: what can't be decoded stays as it is, a missing end of a part is the end of the message.
"""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

#: Parts are opened so deep; Python's recursion has a limit. A part below it is shown as it is.
DEPTH = 100
#: A signature has at most so many lines, each shorter than this; what follows is read again.
SIGNATURE, SHORT = 10, 100
#: A line this long is a paragraph of the message, also if it has the words of a disclaimer.
LONG = 1_000
_BLANK = re.compile(r"\n[ \t]*\n")
_FIELD = re.compile(r"^([!-9;-~]+)[ \t]*:(.*)$")
_PARAM = re.compile(r';\s*([\w*-]+)\s*=\s*("[^"]*"|[^;\s]+)')
_QUOTE = re.compile(r"^(?:[ \t]*[>|])+[ \t]?")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
_HIDDEN = re.compile(r"(?is)<(script|style|head|title)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
_LINK = re.compile(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]*)[^>]*>")
_BREAK = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|blockquote|hr|dd|dt|section|article)\b[^>]*>")
_CELL = re.compile(r"(?i)</t[dh]\s*>")
_TAG = re.compile(r"<[A-Za-z/!][^>]*>?")
_RULE = re.compile(r"^[\s_*=~#-]{5,}$")
# How disclaimers and footers of lists are worded in mail archives, in the archive's languages.
_DISCLAIMER = (
    "confidential", "privileged", "meant for the addressee", "recorded for quality", "consider the trees", "vertraulich", "confidentiel",
    "confidencial", "конфиденциальн", "機密", "unsubscribe",
)
_LIST_PAGE = re.compile(r"(?i)/info/[\w.-]+$")
_ATTRIBUTION = re.compile(r"(?i)(?:wrote|schrieb|a écrit|escribió|пишет|написал\w*|のメール|書きました|wrote on .*)\s*[:：]\s*$")
_ORIGINAL = re.compile(r"^-{3,}.{3,60}-{3,}$")
_OLD_FIELD = re.compile(r"^(?:From|Sent|To|Cc|Subject|Date|Von|Gesendet|An|Betreff|De|Envoyé|À|Objet|Para|Enviado|Asunto|От|Кому|Тема)\s*:", re.I)
# Words that open a greeting or make a closing line.
_GREETING = re.compile(
    r"(?i)^(?:dear|hi|hello|hey|good (?:morning|afternoon|evening)|sehr geehrte|liebe|lieber|hallo|guten|moin|madame|monsieur|chers?|chère|bonjour|salut|"
    r"estimad\w+|hola|querid\w+|buen\w+|здравствуйте|добрый|уважаем\w+|привет|皆様|.*様)\b"
)
_NAME_ONLY = re.compile(r"^[\w' .-]{2,30}\s?[-,!:]$")
_CLOSING = re.compile(
    r"(?i)^(?:(?:best|kind|warm) regards|regards|best|thanks|thank you|cheers|talk soon|yours\b.*|sincerely|mit freundlichen grüßen|viele grüße|"
    r"bis bald|cordialement|bien à vous|à bientôt|un saludo|saludos\b.*|hasta pronto|с уважением|до встречи|всего доброго|よろしくお願い.*|以上です.*)[,.!。]?$"
)


def fields(head: str) -> dict[str, str]:
    """The fields of a header block, names in lower case, continuation lines joined; the first of a name counts."""
    out: dict[str, str] = {}
    name = None
    for line in head.split("\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif m := _FIELD.match(line):
            name = m.group(1).lower()
            if name in out:
                name = None
            else:
                out[name] = m.group(2).strip()
    return out


def undo(payload: str, encoding: str, charset: str) -> str:
    """The payload without its transfer encoding."""
    encoding = encoding.strip().lower()
    if encoding == "base64":
        clean = _NOT_BASE64.sub("", payload.split("=")[0] if payload.count("=") > 2 else payload)
        try:
            raw = base64.b64decode(clean[: len(clean) // 4 * 4] if len(clean) % 4 == 1 else clean + "=" * (-len(clean) % 4))
        except (binascii.Error, ValueError):
            return payload
    elif encoding == "quoted-printable":
        raw = quopri.decodestring(payload.encode("utf-8", "surrogatepass"))
    else:
        return payload
    for cs in (charset or "utf-8", "utf-8"):
        try:
            return raw.decode(cs)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace")


def shown(markup: str) -> str:
    """HTML as text: blocks on lines of their own; the address of a link follows its text, as its target."""
    s = _HIDDEN.sub(" ", markup)
    s = s.replace("\n", " ")
    s = _LINK.sub(lambda m: f" {m.group(1)} ", s)
    s = _TAG.sub("", _CELL.sub(" ", _BREAK.sub("\n", s)))
    return html.unescape(s)


def _parts(body: str, boundary: str) -> list[str]:
    out, keep, at = [], None, f"--{boundary}"
    for line in body.split("\n"):
        if line.rstrip() == at or line.rstrip() == f"{at}--":
            if keep is not None:
                out.append("\n".join(keep))
            keep = None if line.rstrip().endswith(f"{boundary}--") else []
        elif keep is not None:
            keep.append(line)
    if keep is not None:
        out.append("\n".join(keep))
    return out


def _split(message: str) -> tuple[str, str]:
    """Header and body. An empty line ends the header; one of blanks only where no field follows, as it may be the rest
    of a folded field."""
    for m in _BLANK.finditer(message):
        if m.group(0) == "\n\n" or not _FIELD.match(message[m.end() :].split("\n", 1)[0]):
            return message[: m.start()], message[m.end() :]
    return message, ""


def content(message: str, depth: int = 0, top: bool = True) -> str:
    """The texts of a message or part that are shown."""
    head, body = "", message
    opening = message.split("\n", 1)[0]
    if message.startswith("\n"):
        body = message[1:]
    elif _FIELD.match(opening) or opening.startswith("From "):
        head, body = _split(message)
    f = fields(head)
    kind = f.get("content-type", "text/plain")
    mime = kind.split(";")[0].strip().lower() or "text/plain"
    params = {k.lower(): v.strip('"') for k, v in _PARAM.findall(kind)}
    if f.get("content-disposition", "").lower().startswith("attachment") or (not top and "name" in params):
        return ""
    if mime.startswith("multipart/") and "boundary" in params and depth < DEPTH:
        parts = _parts(body, params["boundary"])
        if not parts:
            return body
        if mime == "multipart/alternative":
            texts = [(content(p, depth + 1, False), p) for p in parts]
            good = [t for t, _ in texts if t.strip()]
            return good[-1] if good else ""
        return "\n\n".join(t for p in parts if (t := content(p, depth + 1, False)).strip())
    if not mime.startswith("text/") and "/" in mime:
        return ""
    text = undo(body, f.get("content-transfer-encoding", ""), params.get("charset", ""))
    looks = mime == "text/html" or re.match(r"(?is)\s*<(?:!doctype|html|body)\b", text)
    return shown(text) if looks else text


def _standing(line: str) -> bool:
    """Whether a line is worded as disclaimers and footers are."""
    low = line.lower()
    return any(x in low for x in _DISCLAIMER) or low.endswith("mailing list") or ("/info/" in low and bool(_LIST_PAGE.search(line)))


def _greets(line: str) -> bool:
    """A greeting has few words, or ends as one does."""
    return bool(_GREETING.match(line)) and (line.count(" ") <= 5 or (line[-1] in ",!:、，" and len(line) < SHORT))


def lines_of(message: str) -> list[str]:
    """The lines of the body that a reader reads as its content."""
    text = content(message.replace("\r\n", "\n").replace("\r", "\n"))
    out: list[str] = []
    level, skip, boiler, fresh = 0, 0, False, True  # skip: lines of a signature that may still come
    for raw in text.split("\n"):
        line = raw.strip()
        depth = 0
        if line[:1] in (">", "|") and (m := _QUOTE.match(raw)):
            marks = m.group(0)
            depth = marks.count(">") + marks.count("|")
            line = raw[m.end() :].strip()
        if depth != level:
            level, skip, boiler, fresh = depth, 0, False, True
        if not line:
            boiler = False
            if not skip:
                out.append("")
            continue
        first = line[0]
        if first == "-" and _ORIGINAL.match(line):
            skip, boiler, fresh = 0, False, True
            continue
        size = len(line)
        if skip:
            if size < SHORT and not _greets(line) and not (line[-1] in ":：" and _ATTRIBUTION.search(line)):
                skip -= 1
                continue
            skip, fresh = 0, True
        if size < SHORT:
            if line == "--" or _CLOSING.match(line):
                skip = SIGNATURE
                continue
            if first in "_*=~#-" and _RULE.match(line):
                boiler = True
                continue
            if fresh and (_greets(line) or _NAME_ONLY.match(line)):
                fresh = False
                continue
        if line[-1] in ":：" and _ATTRIBUTION.search(line):
            fresh = True
            continue
        if fresh and _OLD_FIELD.match(line):
            continue
        if (size < LONG or boiler) and _standing(line):
            boiler = True
            continue
        if boiler and size < LONG and not out[-1:] == [""]:
            # the rest of a disclaimer whose words go on in the next lines
            if first.islower():
                continue
            boiler = False
        fresh = False
        out.append(line)
    return out
