"""The main body of a page among menus, notices, sidebars and footers, by minimum-cut labelling.

Every visible line is a node, and so is every DOM container that holds lines. One linear classifier over a line's shape, tag
and wording gives the terminal capacities of lines, another over a container's content and place those of containers;
edges to the next line and from each line to its container give smoothness. Neither classifier sees what the other sees:
the minimum cut settles at once which containers are content and which lines go against their container.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarp.llm.characters import plain
from sitewarp.llm.main_body_weights import CONTAINER_WEIGHTS, LINE_WEIGHTS
from sitewarp.llm.mincut import min_cut
from sitewarp.llm.phrases import Phrases

#: Smoothness between neighbouring lines and between a line and its container, in the line classifier's log-odds, which
#: is fitted beside the latter; and the weight, per line, of a container's own log-odds.
ADJACENT, CONTAINER, PER_LINE = 0.2, 5.0, 10.0

# Wording of page furniture in the languages of the corpus.
WORDING = {
    "cookie": r"cookies?\b|small files on your device|your privacy choices|kleine dateien|ihre auswahl|sus opciones|vos choix|файлы для корзины|accept all|fichiers? témoins?",
    "share": r"^share\b|share this|tell a friend|send this to|save for later|what you read\?|seite teilen|weitersagen|artikel merken|link kopieren|faites passer|partager|copier le lien|compartir|páselo|guardar \||copiar (el )?enlace|подели|отправьте другу|сохранить \||скопировать ссылку",
    "letters": r"sign up for|never miss|readers: one mail|abonnieren und|keine neuigkeit|la lettre de|ne manquez rien|no se pierda|el boletín de|оставьте адрес|подпи(?:шитесь|ска)|рассылк",
    "byline": r"^(?:written by|by|text and photos:|text:|von|texte ?:|par|por|texto:|автор:?) \S+(?: \S+){0,4}$|\| *\d+ *(?:min|мин)",
    "date": r"^(?:\d{4}-\d\d?-\d\d?|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{1,2}\.? (?:de )?[^\W\d_]+\.? (?:de )?\d{4}(?: г\.)?|[^\W\d_]+ \d{1,2}, \d{4})$",
    "trail": r"^[^>›»]{1,40} [>›»] ",
    "legal": r"©|rights reserved|vorbehalten|droits réservés|derechos reservados|права защищены|may be copied|statements on this website|is a trade name|include sales tax|serving suggestions|powered by|toute copie|est une marque de|toutes taxes|ist eine marke der|vervielfältigung nur|inklusive steuer|copia sin permiso|es una marca de|con impuestos|копирование только|цены указаны|торговая марка|является маркой",
    "phone": r"^tel\b|^phone\b|^тел\b",
    "skip": r"^(?:skip to|zum inhalt|aller au contenu|ir al contenido|к содержанию)",
    "related": r"^(?:more from this section|related reading|others looked at|you may also like|lesen sie auch|mehr zum thema|das könnte sie|à lire aussi|vous aimerez|también le puede|más de esta|lea también|читайте также|вам также|ещё по теме|dans la même|plus d'articles|aus diesem)",
    "comment": r"^\S+(?: \S+)? (?:says|schreibt|écrit|escribe|dice|dit|sagt|пишет|говорит) ?:",
    "promotion": r"^(?:free delivery|rated \d|back in stock|now open|versand frei|livraison offerte|envío gratis|бесплатная доставка)",
    "scripts": r"javascript|\bscripts?\b|scripting|скрипт",
}
_WORDING = Phrases(WORDING)
_TAG = re.compile(r"<(?:!--.*?-->|(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>)([^<]*)", re.S)
_LETTERS = re.compile(r"[\W_]+")
_ENDS = tuple(".!?…。！।")
_SEPARATORS = re.compile(r" [|/·•>] ")
_BOXES = frozenset("div nav main article aside footer header td th section form body".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset("script style noscript template title head svg canvas textarea".split())
_KINDS = frozenset("h1 h2 h3 h4 h5 h6 p li a dt dd pre td th figcaption blockquote".split())
_ROLES = {"nav": "nav", "footer": "footer", "aside": "aside", "header": "header", "main": "main", "article": "main"}


def dom_blocks(html: str) -> list[tuple[str, int, str, frozenset[str]]]:
    """(letters and digits, container, tag, roles of its ancestors) of every visible text node, in order.
    Tolerant: unclosed tags end with their container, unmatched end tags are ignored."""
    start = html.find("<body")
    stack: list[tuple[str, int, frozenset[str]]] = [("body", 0, frozenset())]
    boxes, out, silent = 0, [], 0
    for m in _TAG.finditer(html, max(start, 0)):
        close, tag, _, text = m.groups()
        if tag:
            tag = tag.lower()
            if close:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        silent -= sum(x[0] in _SILENT for x in stack[i:])
                        del stack[i:]
                        break
            elif tag not in _VOID and not m.group(3).endswith("/"):
                _, box, roles = stack[-1]
                if tag in _BOXES:
                    boxes += 1
                    box = boxes
                    if tag in _ROLES:
                        roles = roles | {_ROLES[tag]}
                stack.append((tag, box, roles))
                silent += tag in _SILENT
        if not silent and text and (letters := _LETTERS.sub("", unescape(text))):
            kind = next((x[0] for x in reversed(stack) if x[0] in _KINDS), "")
            if kind == "a" and any(x[0] == "li" for x in stack):
                kind = "link"
            out.append((letters, stack[-1][1], kind, stack[-1][2]))
    return out


def placed(lines: list[str], html: str | None) -> list[tuple[int, str, frozenset[str]] | None]:
    """Where each line stands in the DOM: the texts of both are matched in order by letters and digits."""
    if not html:
        return [None] * len(lines)
    blocks = dom_blocks(html)
    starts, at = [], 0
    for b in blocks:
        starts.append(at)
        at += len(b[0])
    whole, cursor, out = "".join(b[0] for b in blocks), 0, []
    for line in lines:
        letters = _LETTERS.sub("", line)
        found = whole.find(letters, cursor) if letters else -1
        if found < 0:
            out.append(None)
            continue
        cursor = found + len(letters)
        out.append(blocks[bisect_right(starts, found) - 1][1:])
    return out


def containers(places: list) -> dict[int, list[int]]:
    """The lines of each DOM container."""
    out: dict[int, list[int]] = {}
    for i, p in enumerate(places):
        if p:
            out.setdefault(p[0], []).append(i)
    return out


def line_features(title: str | None, lines: list[str], places: list) -> list[list[str]]:
    """The names of the features that hold for each line, of any length: its shape, tag, wording and place on the page."""
    name = _LETTERS.sub("", title or "").lower()
    out, n = [], len(lines)
    for i, (line, place) in enumerate(zip(lines, places, strict=True)):
        count = len(line.split())
        f = ["bias", "w1" if count < 3 else "w3" if count < 7 else "w7" if count < 13 else "w13" if count < 31 else "w31"]
        f.append("tag:" + place[1] if place else "unplaced")
        low = " ".join(plain(line).split()).lower()
        f += (worded := _WORDING.matching(low))
        if len(_SEPARATORS.findall(line)) > 1:
            f.append("listed")
        if not worded and low.endswith(_ENDS):
            f.append("ends")
        if count > 1 and name and (letters := _LETTERS.sub("", low)) and letters in name:
            f.append("titled")
        f.append("top" if i * 5 < n else "end" if (n - 1 - i) * 5 < n else "middle")
        out.append(f)
    return out


def container_features(lines: list[str], places: list, features: list[list[str]]) -> list[tuple[list[int], list[str]]]:
    """(its lines, the names of the features that hold) for each container."""
    words = [len(x.split()) for x in lines]
    total, headed, out = sum(words) or 1, any(p and p[1] == "h1" for p in places), []
    for members in containers(places).values():
        held = sum(words[i] for i in members)
        scripts = any("scripts" in features[i] for i in members)
        f = ["bias", "headline" if any(places[i][1] == "h1" for i in members) else "beside" if headed else "no headline scripts" if scripts else "no headline"]
        f += ["role:" + r for r in places[members[0]][2]]
        if held > 0.5 * total:
            f.append("bulk")
        if 2 * sum(places[i][1] in ("link", "a") for i in members) > len(members):
            f.append("links")
        if 2 * sum(words[i] for i in members if words[i] > 12) > held:
            f.append("prose")
        out.append((members, f))
    return out


def labels(title: str | None, lines: list[str], html: str | None, cut: bool = True) -> list[bool]:
    """Whether each line is main body. Without ``cut``, by the line classifier alone, to tell what the cut does."""
    places = placed(lines, html)
    features = line_features(title, lines, places)
    unary = [sum(LINE_WEIGHTS.get(k, 0.0) for k in f) for f in features]
    n = len(lines)
    if not cut:
        return [u > 0 for u in unary]
    edges = [(i, i + 1, ADJACENT if not (places[i] and places[i + 1]) or places[i][0] == places[i + 1][0] else ADJACENT / 4) for i in range(n - 1)]
    for members, f in container_features(lines, places, features):
        edges += [(i, len(unary), CONTAINER) for i in members]
        unary.append(PER_LINE * len(members) * sum(CONTAINER_WEIGHTS.get(k, 0.0) for k in f))
    return min_cut(unary, edges)[:n]


def body_lines(title: str | None, text: str | None, html: str | None, cut: bool = True) -> list[int]:
    """The numbers, from 1, of the non-blank lines that belong to the main body."""
    numbers = [(i, x) for i, x in enumerate((text or "").split("\n"), 1) if x.strip()]
    return [i for (i, _), keep in zip(numbers, labels(title, [x for _, x in numbers], html, cut), strict=True) if keep]


def pages_with_html(page: DataFrame, page_raw: DataFrame, columns: list[str]) -> DataFrame:
    """``page_id``, ``columns`` and the ``html`` of the page's own request: same url, fetched within a second of ``crawled_at``.

    Joined on url and ten-second slot, so a url fetched over and over is no hot key; html rows at the edge of a
    slot stand in both. Repeated requests are dropped before the join. Pages without html stay, with null.
    """
    seconds = F.unix_micros("fetched_at") / 1e6
    slots = F.array_distinct(F.array(F.floor((seconds - 1) / 10), F.floor((seconds + 1) / 10)))
    html = page_raw.where("html is not null and url is not null and fetched_at is not null").select(F.col("url").alias("__url"), F.col("fetched_at").alias("__at"), F.explode(slots).alias("__slot"), "html")
    html = html.repartition("__url", "__slot").dropDuplicates(["__url", "__slot", "__at"])
    near = (F.col("__url") == F.col("url")) & (F.col("__slot") == F.floor(F.unix_micros("crawled_at") / 1e7)) & (F.abs(F.unix_micros("__at") - F.unix_micros("crawled_at")) <= 1_000_000)
    wanted = list(dict.fromkeys(["page_id", "url", "crawled_at", *columns]))
    return page.select(*wanted).join(html, near, "left").select("page_id", *columns, "html")


def main_body_lines(page: DataFrame, page_raw: DataFrame) -> DataFrame:
    """(page_id, line_no) of every main-body line, numbered from 1 with blank lines counted.

    Null or empty text has no lines; a page without html is labelled from its text alone; repeated pages
    and requests give each line once; other columns, of whatever name, are ignored.
    """
    rows = pages_with_html(page, page_raw, ["title", "text"]).where("text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, seen = [], set()
            for page_id, title, text, html in zip(batch.page_id, batch.title, batch.text, batch.html, strict=True):
                if (key := (page_id, text)) not in seen:
                    seen.add(key)
                    out += [(page_id, k) for k in body_lines(title, text, html)]
            yield pd.DataFrame(out, columns=["page_id", "line_no"])

    return rows.mapInPandas(run, "page_id bigint, line_no int").dropDuplicates(["page_id", "line_no"])
