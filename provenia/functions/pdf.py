"""Text of PDF files: a lexer of PDF syntax, the objects of a file, and the text that its content streams show."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from provenia import codes

PDF_OK, PDF_NO_TEXT, PDF_GARBLED, PDF_ENCRYPTED = "PDF_OK", "PDF_NO_TEXT_LAYER", "PDF_TEXT_GARBLED", "PDF_ENCRYPTED"
#: Marks of pictures, and the limits below which text is none or isn't language.
PICTURES = (b"/DCTDecode", b"/JPXDecode", b"/CCITTFaxDecode", b"/JBIG2Decode", b"/Image")
LEAST_CHARS = 20
LEAST_PRINTABLE, LEAST_SPACES = 0.90, 0.05
#: Bytes of a character map that is read, and codes of one range.
MAP_BYTES, MAP_RANGE = 200_000, 65_536

# ---------------------------------------------------------------- lexer

_BLANK = b"\0\t\n\f\r "
_DELIMITER = b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)+")
_CONTROL = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


class Word(bytes):
    """An operator or keyword."""


class Name(bytes):
    """A name, without its slash."""


class Mark(bytes):
    """A bracket of an array, dictionary or procedure."""


def lexed(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """(token, end of it): bytes for strings, floats for numbers, and Word, Name and Mark."""
    size = len(data)
    while at < size:
        if m := _SKIP.match(data, at):
            at = m.end()
            continue
        head = data[at : at + 1]
        if head == b"(":
            token, at = _string(data, at + 1)
        elif data[at : at + 2] in (b"<<", b">>"):
            token, at = Mark(data[at : at + 2]), at + 2
        elif head == b"<":
            end = data.find(b">", at)
            end = size if end < 0 else end
            digits = bytes(c for c in data[at + 1 : end] if c in b"0123456789abcdefABCDEF")
            token, at = bytes.fromhex((digits + b"0" * (len(digits) & 1)).decode()), end + 1
        elif head == b"/":
            m = _REGULAR.match(data, at + 1)
            token, at = Name(m[0] if m else b""), m.end() if m else at + 1
        elif head in (b"[", b"]", b"{", b"}", b")", b">"):
            token, at = Mark(head), at + 1
        else:
            m = _REGULAR.match(data, at)
            at = m.end()
            try:
                token = float(m[0])
            except ValueError:
                token = Word(m[0])
        yield token, at


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string from behind its first parenthesis; parentheses inside it balance or are escaped."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        at += 1
        if c == 0x5C and at < len(data):
            c = data[at]
            at += 1
            if 0x30 <= c <= 0x37:
                octal = c - 0x30
                for _ in range(2):
                    if at < len(data) and 0x30 <= data[at] <= 0x37:
                        octal, at = octal * 8 + data[at] - 0x30, at + 1
                out.append(octal & 255)
            elif c == 13:  # the line goes on
                at += data[at : at + 1] == b"\n"
            elif c != 10:
                out.append(_CONTROL.get(c, c))
            continue
        depth += (c == 0x28) - (c == 0x29)
        if not depth:
            break
        out.append(c)
    return bytes(out), at


# ---------------------------------------------------------------- objects

_OBJECT = re.compile(rb"\d+\s+\d+\s+obj\b")


def objects(data: bytes) -> Iterator[tuple[list[bytes], bytes | None]]:
    """(names in its first dictionary, bytes of its stream or None) of each object; a stream that can't be undone is None."""
    at = 0
    while m := _OBJECT.search(data, at):
        names, depth, at = [], 0, m.end()
        for token, end in lexed(data, m.end()):
            at = end
            if isinstance(token, Mark):
                depth += {b"<<": 1, b">>": -1}.get(bytes(token), 0)
            elif isinstance(token, Name):
                names.append(bytes(token))
            elif token == b"stream" and isinstance(token, Word) or not depth:
                break
        if data[at - 6 : at] != b"stream":
            yield names, None
            continue
        at += 2 if data[at : at + 2] == b"\r\n" else data[at : at + 1] in (b"\r", b"\n")
        end = data.find(b"endstream", at)
        if end < 0:
            return
        yield names, _plain(names, data[at:end])
        at = end


def _plain(names: list[bytes], body: bytes) -> bytes | None:
    filters = [n for n in names if n.endswith((b"Decode", b"Crypt"))]
    if not filters:
        return None if b"Filter" in names else body
    if filters != [b"FlateDecode"]:
        return None
    try:
        return zlib.decompressobj().decompress(body)
    except zlib.error:
        return None


# ---------------------------------------------------------------- characters

class CharacterMap:
    """Two-byte codes of all maps of a file; a code that two maps give different texts is disputed and left out."""

    def __init__(self):
        self.texts: dict[int, str] = {}
        self.disputed: set[int] = set()

    def put(self, code: int, text: str) -> None:
        if self.texts.setdefault(code, text) != text:
            self.disputed.add(code)

    def read(self, content: bytes) -> None:
        held: list = []
        for token, _ in lexed(content):
            if token in (b"endbfchar", b"endbfrange") and isinstance(token, Word):
                self._single(held) if token == b"endbfchar" else self._ranges(held)
            if isinstance(token, Word):
                held = []
            elif not isinstance(token, (float, Name)):
                held.append(token)

    def _single(self, held: list) -> None:
        strings = [x for x in held if not isinstance(x, Mark)]
        for code, text in zip(strings[::2], strings[1::2]):
            self.put(int.from_bytes(code, "big"), _utf16(text))

    def _ranges(self, held: list) -> None:
        held = held[::-1]
        while len(held) >= 3:
            low, high, to = held.pop(), held.pop(), held.pop()
            if isinstance(low, Mark) or isinstance(high, Mark):
                return
            low, high = int.from_bytes(low, "big"), int.from_bytes(high, "big")
            if isinstance(to, Mark):  # an array: one text for each code
                while held and not isinstance(text := held.pop(), Mark):
                    self.put(low, _utf16(text))
                    low += 1
            elif first := _utf16(to):
                for code in range(low, min(high + 1, low + MAP_RANGE)):
                    self.put(code, first[:-1] + chr(min(0x10FFFF, ord(first[-1]) + code - low)))

    def decode(self, raw: bytes) -> str:
        """By two-byte codes if all of them are known and the bytes can't be plain text; else UTF-16 or single bytes."""
        codes_ = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)]
        control = any(b < 0x20 and b not in b"\t\n\r" for b in raw)
        if control and not len(raw) & 1 and all(c in self.texts and c not in self.disputed for c in codes_):
            return "".join(self.texts[c] for c in codes_)
        if raw.startswith(b"\xfe\xff"):
            return _utf16(raw[2:])
        return re.sub("[\x80-\x9f]", lambda m: m[0].encode("latin-1").decode("cp1252", "replace"), raw.decode("latin-1"))


def _utf16(raw: bytes) -> str:
    return (b"\0" * (len(raw) & 1) + raw).decode("utf-16-be", "replace")


def shown(content: bytes, characters: CharacterMap) -> str:
    """What a content stream's text operators show; a new line only where the text moves down or a text object ends."""
    out: list[str] = []
    operands: list = []
    for token, _ in lexed(content):
        if not isinstance(token, Word):
            operands.append(token)
            continue
        numbers = [x for x in operands if isinstance(x, float)]
        match bytes(token):
            case b"Tj" | b"TJ" | b"'" | b'"' as operator:
                out.append("\n" if operator in (b"'", b'"') else "")
                out += [characters.decode(x) for x in operands if type(x) is bytes]
            case b"Td" | b"TD" if len(numbers) > 1 and numbers[-1]:
                out.append("\n")
            case b"T*" | b"ET":
                out.append("\n")
        operands = []
    return "".join(out)


def cleaned(text: str) -> str:
    """Lines without control characters and repeated blanks, words that a line's end cut put together, one empty line at most."""
    lines: list[str] = []
    for line in text.replace("\r", "\n").split("\n"):
        line = " ".join("".join(c for c in line if c == "\t" or ord(c) >= 0x20 and c != "\x7f").replace("\t", " ").split(" ")).strip()
        line = re.sub(" {2,}", " ", line)
        last = lines[-1] if lines else ""
        if re.search(r"\w-$", last) and re.match(r"\w", line):
            lines[-1] = last[:-1] + line
        elif line or last:
            lines.append(line)
    return "\n".join(lines).strip()


def pdf_text(data: bytes) -> dict:
    """code, text, detail and what the decision rests on. Text that isn't language is refused, never passed on."""
    read = {"code": PDF_OK, "text": "", "detail": "", "pages": 0, "has_images": any(mark in data for mark in PICTURES)}
    if re.search(rb"/Encrypt\b", data):
        return read | {"code": PDF_ENCRYPTED, "detail": "encrypted"}
    characters, contents = CharacterMap(), []
    for names, body in objects(data):
        read["pages"] += any(a == b"Type" and b == b"Page" for a, b in zip(names, names[1:]))
        if body is not None and b"beginbf" not in body:
            contents.append(body)
        elif body is not None and len(body) <= MAP_BYTES and b"/Identity-" in data:
            characters.read(body)
    text = cleaned("".join(shown(body, characters) for body in contents))
    printable = sum(c.isprintable() or c == "\n" for c in text) / max(1, len(text))
    spaces = sum(map(str.isspace, text)) / max(1, len(text))
    disputed = len(characters.disputed)
    read |= {"two_byte_codes": len(characters.texts) - disputed, "two_byte_conflicts": disputed, "printable_ratio": round(printable, 4), "space_ratio": round(spaces, 4)}
    if len(text) < LEAST_CHARS or read["has_images"] and len(text) < codes.EMPTY_CHARS:
        return read | {"code": PDF_NO_TEXT, "detail": "no text layer"}
    if printable < LEAST_PRINTABLE or spaces < LEAST_SPACES:
        return read | {"code": PDF_GARBLED, "detail": "what decodes isn't language"}
    return read | {"text": text}
