"""Pasted notes made safe: an allow-list of tags, attributes and styles."""

from __future__ import annotations

import math
import re
from html import escape
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Tags that stay, tags that go with all they hold (others go, what they hold
#: stays), tags without an end, and styles that stay.
KEPT = frozenset(
    "p div section h1 h2 h3 h4 h5 h6 blockquote ul ol li pre code strong b em i u s mark small sub sup span font br hr a img figure figcaption"
    " table caption thead tbody tfoot tr th td colgroup col details summary".split()
)
DROPPED = frozenset("script style noscript iframe object embed svg math form input button textarea select option template link meta base audio video source canvas".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
STYLES = frozenset(
    "color background-color font-family font-size font-weight font-style text-decoration text-decoration-line text-align line-height letter-spacing text-indent"
    " white-space vertical-align margin margin-top margin-right margin-bottom margin-left padding padding-top padding-right padding-bottom padding-left border"
    " border-width border-style border-color border-top border-right border-bottom border-left border-collapse border-spacing width min-width max-width height"
    " max-height list-style-type".split()
)
UNSAFE = re.compile(r"[{}<>\x00-\x1f]|url\s*\(|expression\s*\(|javascript:|@import|behavior\s*:|-moz-binding", re.I)
LINK = re.compile(r"(?:https?://|mailto:)", re.I)
IMAGE = re.compile(r"/api/[a-z0-9_./%?=&+-]+|data:image/(?:png|jpe?g|gif|webp);base64,[a-z0-9+/=\r\n]+", re.I)
FACE, COLOR = re.compile(r"[\w\s,\"'.-]{1,200}"), re.compile(r"#[0-9a-f]{3,8}|[a-z]{1,30}|rgba?\([\d\s.,%]+\)|hsla?\([\d\s.,%a-z]+\)", re.I)
#: Whole-number attributes: of which tags, and their greatest value.
NUMBERS = {"width": ({"img", "table", "col", "th", "td"}, 4000), "height": ({"img"}, 4000), "colspan": ({"th", "td"}, 50), "rowspan": ({"th", "td"}, 100), "size": ({"font"}, 7)}
REMOVED = "[图片已移除]"
#: Bytes of the longest note, characters of the longest word note, and of an address.
MOST_BYTES, MOST_WORD, MOST_ADDRESS = 8_000_000, 2_000_000, 4000
#: Fixed values of the form for word documents: tags that stay, those that may be aligned and
#: indented, those that go with all they hold; of others the text stays.
WORD_KEPT = frozenset("p div h1 h2 h3 blockquote ul ol li pre code strong b em i u s span br a".split())
WORD_BLOCKS = frozenset("p div h1 h2 h3 blockquote li pre".split())
WORD_DROPPED = frozenset("script style noscript iframe object embed svg math form".split())
ALIGNMENTS, MOST_INDENT = ("left", "center", "right", "justify"), 4
ALIGN = re.compile(r"(?:^|;)\s*text-align\s*:\s*(left|center|right|justify)\b", re.I)
MARGIN = re.compile(r"(?:^|;)\s*margin-left\s*:\s*(\d+(?:\.\d+)?)\s*(px|em)\b", re.I)


def safe_style(style: str) -> str:
    kept = []
    for part in style.split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip()
        if colon and name in STYLES and value and len(value) <= 240 and not UNSAFE.search(value):
            kept.append(f"{name}: {value}")
    return "; ".join(kept)


def whole(value: str, most: int) -> str | None:
    try:
        number = math.floor(float(value) + 0.5)
    except (ValueError, OverflowError):
        return None
    return str(min(most, number)) if number > 0 else None


def safe_image(source: str) -> str | None:
    """An image of the library itself, by path or by an address of this machine, or one that is
    in the note."""
    source = source.strip()
    if IMAGE.fullmatch(source):
        return source[:MOST_ADDRESS] if source[:1] == "/" else source
    try:
        whole_ = urlsplit(source)
        if (whole_.hostname or "").lower() in ("127.0.0.1", "localhost") and whole_.path.startswith("/api/"):
            return f"{whole_.path}{'?' if whole_.query else ''}{whole_.query}"[:MOST_ADDRESS]
    except ValueError:
        pass
    return None


class Cleaner(HTMLParser):
    """Writes what is allowed. Tags that are not closed are closed at the end of what holds
    them; ends without a begin are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden or tag in DROPPED:
            if tag not in EMPTY:
                self.hidden.append(tag)
            return
        if tag not in KEPT:
            return
        has = {k: v or "" for k, v in reversed(attrs)}
        put: dict[str, str | None] = {"style": safe_style(has.get("style", ""))}
        if tag == "a" and LINK.match(href := has.get("href", "").strip()):
            put |= {"href": href[:2000], "target": "_blank", "rel": "noopener noreferrer", "title": None}
        if tag == "img":
            source = safe_image(has.get("src", ""))
            if source is None:
                self.handle_data(has.get("alt", "")[:500] or REMOVED)
                return
            put |= {"src": source, "loading": "lazy", "alt": has.get("alt", "")[:500], "title": has.get("title", "")[:500]}
        for name, (tags, most) in NUMBERS.items():
            if tag in tags:
                put[name] = whole(has.get(name, ""), most)
        if tag == "font":
            face, color = has.get("face", "").strip(), has.get("color", "").strip()
            put |= {"face": face if FACE.fullmatch(face) else None, "color": color if COLOR.fullmatch(color) else None}
        self.out.append(f"<{tag}{''.join(f' {k}="{escape(v)}"' for k, v in put.items() if v)}>")
        if tag not in EMPTY:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
            return
        if tag in self.open:
            while True:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(escape(data, quote=False))

    def done(self) -> str:
        self.close()
        self.out += [f"</{t}>" for t in reversed(self.open)]
        return "".join(self.out)


def block_format(has: dict[str, str]) -> dict[str, str | None]:
    """Alignment and indent of a block, from its own attributes or its style."""
    style = has.get("style", "")
    told = ALIGN.search(style)
    align = (has.get("data-align") or has.get("align") or (told[1] if told else "")).lower()
    margin = MARGIN.search(style)
    level = math.floor(float(margin[1]) / (2 if margin[2].lower() == "em" else 40) + 0.5) if margin else 0
    try:
        number = float(has["data-indent"].strip() or 0)
        level = math.floor(number + 0.5) if math.isfinite(number) else level
    except (KeyError, ValueError):
        pass
    level = max(0, min(MOST_INDENT, level))
    return {"data-align": align if align in ALIGNMENTS else None, "data-indent": str(level) if level else None}


class WordCleaner(Cleaner):
    """The form for word documents. Inside a tag that isn't kept, only text is."""

    def __init__(self) -> None:
        super().__init__()
        self.bare: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden or tag in WORD_DROPPED:
            if tag not in EMPTY:
                self.hidden.append(tag)
            return
        if self.bare or tag not in WORD_KEPT:
            if tag not in EMPTY:
                self.bare.append(tag)
            return
        has = {k: v or "" for k, v in reversed(attrs)}
        put = block_format(has) if tag in WORD_BLOCKS else {}
        if tag == "a" and LINK.match(href := has.get("href", "").strip()):
            put["href"] = href[:2000]
        self.out.append(f"<{tag}{''.join(f' {k}="{escape(v)}"' for k, v in put.items() if v)}>")
        if tag not in EMPTY:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.bare and not self.hidden:
            if tag in self.bare:
                del self.bare[len(self.bare) - 1 - self.bare[::-1].index(tag) :]
            return
        super().handle_endtag(tag)


def cleaned(cleaner: Cleaner, html: str) -> str:
    cleaner.feed(html)
    return cleaner.done()


def clean(html: str | None) -> str | None:
    made = None if html is None else cleaned(Cleaner(), html)
    return None if made is None or len(made.encode("utf-8", "replace")) > MOST_BYTES else made


def clean_word(html: str | None) -> str | None:
    return None if html is None else cleaned(WordCleaner(), html)[:MOST_WORD]


def sanitize_word_html(html: Column) -> Column:
    """A word document's html with paragraphs, headings, lists, emphasis and links, alignment and
    indent; cut to 2 000 000 characters."""

    @pandas_udf("string")
    def run(notes: pd.Series) -> pd.Series:
        return pd.Series([clean_word(x) for x in notes], dtype=object)

    return run(html)


def sanitize_note_html(html: Column) -> Column:
    """A pasted note's html without scripts, unknown tags, unsafe links, images and styles; null
    if more than 8 000 000 bytes are left, which no note may have."""

    @pandas_udf("string")
    def run(notes: pd.Series) -> pd.Series:
        return pd.Series([clean(x) for x in notes], dtype=object)

    return run(html)
