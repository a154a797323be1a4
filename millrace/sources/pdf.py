"""Native text of PDF files by their objects: pages in order, streams inflated, strings of text operators decoded.

Encrypted files raise; text of fonts with their own codes is read only where the file maps them (ToUnicode).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]<>()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(token: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\n", b"\r") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, token[1:-1], flags=re.S)


class Document:
    """The objects of a file, those of object streams too."""

    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("no PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("an encrypted PDF file")
        self.objects: dict[int, bytes] = {int(n): body for n, _, body in _OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                text = self.stream(body)
                n, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
                head = list(map(int, text[:first].split()[: 2 * n]))
                ends = [*head[3::2], len(text) - first]
                for number, a, b in zip(head[::2], head[1::2], ends, strict=True):
                    self.objects.setdefault(number, text[first + a : first + b])

    @staticmethod
    def stream(body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        if b"/FlateDecode" in body[: m.start()]:
            return zlib.decompressobj().decompress(m[1])
        return m[1]

    def _refers(self, body: bytes, key: bytes) -> list[int]:
        m = re.search(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % key, body)
        return [int(x) for x in _REFERENCE.findall(m[1])] if m else []

    def pages(self) -> list[bytes]:
        """The page objects, in the order of the page tree."""
        roots = [n for n, b in self.objects.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b]
        out: list[bytes] = []

        def walk(n: int, above: frozenset[int]) -> None:
            body = self.objects.get(n, b"")
            if n in above:
                return
            if re.search(rb"/Type\s*/Pages\b", body):
                for k in self._refers(body, b"Kids"):
                    walk(k, above | {n})
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(body)

        for n in sorted(roots):
            walk(n, frozenset())
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b", b)]

    def _codes(self, page: bytes) -> dict[bytes, dict[int, str]]:
        """By font name the characters of two-byte codes that the file maps."""
        out = {}
        resources = self._refers(page, b"Resources")
        body = self.objects.get(resources[0], b"") if resources else page
        fonts = re.search(rb"/Font\s*(<<.*?>>|\d+\s+\d+\s+R)", body, re.S)
        listed = self.objects.get(int(_REFERENCE.match(fonts[1])[1]), b"") if fonts and _REFERENCE.match(fonts[1]) else fonts[1] if fonts else b""
        for name, n in re.findall(rb"(/[^\s/<>]+)\s+(\d+)\s+\d+\s+R", listed):
            maps = self._refers(self.objects.get(int(n), b""), b"ToUnicode")
            if maps:
                out[name] = self._map(self.stream(self.objects.get(maps[0], b"")))
        return out

    @staticmethod
    def _map(text: bytes) -> dict[int, str]:
        codes = {}
        decode = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
            codes |= {int(a, 16): decode(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                for k in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1):
                    codes[k] = chr(int(c, 16) + k - int(a, 16)) if len(c) <= 4 else decode(c)
        return codes

    def text(self, page: bytes) -> str:
        """A page's text: a line for each move to another line."""
        content = b"\n".join(self.stream(self.objects.get(n, b"")) for n in self._refers(page, b"Contents"))
        codes, font, lines, line, args = self._codes(page), b"", [], [], []

        def show(token: bytes) -> None:
            raw = _literal(token) if token[:1] == b"(" else bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", token[1:-1])) % 2))
            known = codes.get(font)
            if known:
                line.append("".join(known.get(int.from_bytes(raw[i : i + 2], "big"), "") for i in range(0, len(raw), 2)))
            else:
                line.append(raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace"))

        def end() -> None:
            if line:
                lines.append("".join(line))
                line.clear()

        for token in _TOKEN.findall(content):
            if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
                args.append(token)
                continue
            shown = [a for a in args if a[:1] in (b"(", b"<")]
            if token == b"Tf" and len(args) > 1:
                font = args[-2]
            elif token in (b"Td", b"TD") and len(args) > 1 and float(args[-1]) or token in (b"T*", b"Tm", b"ET"):
                end()
            elif token in (b"'", b'"'):
                end()
            if token in (b"Tj", b"'", b'"') and shown:
                show(shown[-1])
            elif token == b"TJ":
                for a in args:
                    if a[:1] in (b"(", b"<"):
                        show(a)
                    elif a[:1] not in (b"[", b"]", b"/") and float(a) < -200:  # a gap as wide as a space
                        line.append(" ")
            args.clear()
        end()
        return "\n".join(x.rstrip() for x in lines).strip()


def page_texts(data: bytes) -> Iterator[str]:
    """The native text of each page of a PDF file."""
    document = Document(data)
    for page in document.pages():
        yield document.text(page)
