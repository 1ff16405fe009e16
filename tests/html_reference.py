"""Parser-mode HTML split by the standard library, page by page: what the column
expression of ``forumshift.functions.text.split_nested`` is tested against."""

from __future__ import annotations

from html.parser import HTMLParser

SKIP = {"script", "style"}


class _Split(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.code, self._buf = [], [], []
        self._code_depth = 0
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self._skip += 1
        elif tag == "code":
            if self._code_depth == 0:
                self._buf = []
            self._code_depth += 1

    def handle_endtag(self, tag):
        if tag in SKIP and self._skip:
            self._skip -= 1
        elif tag == "code" and self._code_depth:
            self._code_depth -= 1
            if self._code_depth == 0:
                self.code.append("".join(self._buf))

    def handle_data(self, data):
        if self._skip:
            return
        if self._code_depth:
            self._buf.append(data)
            return
        s = data.strip()
        if s:
            self.text.append(s)


def split_one(html: str | None):
    if html is None:
        return None
    p = _Split()
    p.feed(html)
    p.close()
    if p._code_depth:                     # unclosed <code>: keep what was read
        p.code.append("".join(p._buf))
    return {"text": " ".join(p.text), "code": p.code}
