"""Template residue and error-page text: pages to exclude.

Sentences of main-body lines are messages. A fixed-depth prefix tree over the whole corpus (how the wording is read, token count,
leading tokens) mines their templates; each template is classified once, by its wording or by the pages it stands on that
answered with an error, and its verdict goes to every page that holds one of its messages. A page's share of such messages
decides. Unfilled slots are looked for separately in titles and lines of ordinary pages.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import combinations, pairwise
from math import comb
from operator import itemgetter

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarp.llm.characters import plain
from sitewarp.llm.main_body import body_lines, pages_with_html
from sitewarp.llm.phrases import Phrases
from sitewarp.operators.joins import salted_join
from sitewarp.session import cut_lineage

# What error, access, check, maintenance and removed-item messages say.
STATUS = r"""
page not found|could not find (?:that|this|the) page|may have moved or never existed|try the search or go back|^nothing here\W*$|address you typed|this page (?:does not|doesn't) exist
|something went wrong|server met a problem|could not finish your request|try again (?:later|in a few)|internal (?:server )?error|an error (?:has )?occurred|bad gateway|gateway timeout
|access denied|do not have permission|^forbidden|not authori[sz]ed|^incident <\*>|^reference: <\*>|^ray <\*>|^xid: <\*>|^(?:case|code|request|id):? <\*>
|session expired|sign in again|service unavailable|backend fetch failed|too many requests|wait and retry|limit resets in
|(?:down|closed) for maintenance|under maintenance|scheduled maintenance|(?:we are|we'll be|will be) back soon|thank you for your patience
|no longer available|removed by the seller|item was removed|has been (?:removed|deleted)|listing (?:has )?ended
|^(?:\S+ )?fatal error|uncaught \w*error|cannot read property|database connection|query on closed handle|^warning: |stack trace|^traceback
|index of /|^parent directory|^\S+\.(?:tar|zip|gz|bak|sql|log)\b|^\S+/ -$
|^(?:\S+ )?one moment\W*$|checking (?:that )?your browser|browser is safe|verify(?:ing)? (?:that )?you are (?:a )?human|this takes up to|complete the captcha|^just a moment
|seite nicht gefunden|gewünschte adresse|zurück zur startseite|ein fehler ist aufgetreten|versuchen sie es später|^vorgang <\*>|zugriff verweigert|ihnen fehlt das recht|^(?:\S+ )?wartungsarbeiten|gleich wieder da|sitzung (?:ist )?abgelaufen|nicht mehr verfügbar|wegen wartung
|page introuvable|page demandée n'existe|retour à l'accueil|erreur interne|n'a pas pu traiter|site en maintenance|nous revenons bientôt|accès (?:refusé|interdit)|une erreur est survenue|réessayez plus tard|session expirée|n'est plus disponible|^code <\*>
|página no encontrada|página solicitada no existe|dirección que busca|enlace (?:está )?roto|volver al inicio|ha ocurrido un error|inténtelo de nuevo|en mantenimiento|volvemos enseguida|acceso denegado|sesión (?:ha )?(?:caducado|expirado)|ya no está disponible|^caso <\*>
|страница не найдена|такой страницы нет|такого адреса нет|адрес (?:был )?удалён|вернуться на главную|ошибка сервера|попробуйте позже|технические работы|скоро вернёмся|доступ (?:запрещён|закрыт)|сессия истекла|больше не доступен|товар снят|на обслуживании"""
# What unedited samples say.
SAMPLE = r"""
your text goes here|sample text block|replace this paragraph|click edit to change|placeholder copy|write something about yourself|add a line about your team|describe your service in two or three lines
|this is an example page|until you write your own|hi, this is a comment|visit the dashboard|^hello world\W*$|^section title\W*$|^main heading\W*$|^headline\W*$|^untitled(?: (?:page|document))?\W*$|^sample page\W*$|this is your first post|just another \S+ site|edit or delete it|insert (?:your )?text here
|beispieltext|hier steht später|ersetzen sie diesen absatz|dies ist ein blindtext|hier den .{0,20}text einfügen|musterseite|^überschrift\W*$
|votre texte ici|texte d'exemple|remplacez ce paragraphe|ceci est un exemple|^titre de section\W*$|su texto aquí|texto de ejemplo|sustituya este párrafo|ejemplo de página|ваш текст|пример текста|замените этот абзац|образец страницы"""
SCRIPTS = r"""
(?:need|have) to enable (?:javascript|scripts?)|enable (?:javascript|scripts?) to (?:view|use|run|see|continue|access) (?!the comments?|comments)|requires? (?:a modern browser with scripts|javascript|scripts)|only with scripts|javascript is (?:required|disabled)|scripting turned off|allow scripts for|turn (?:on|scripts on)|works only with scripts
|braucht skripte|aktivieren sie (?:bitte )?javascript|javascript (?:muss|ist) |necesita scripts|activ[ea] javascript|activez javascript|besoin de scripts|включите javascript|нужен javascript|требуется javascript"""
# Words of filler text.
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum mauris vestibulum pellentesque vivamus donec nunc integer praesent maecenas".split())
MASH = frozenset("asdf qwer qwerty qwertz azerty foo bar baz test test1 test12 test123 testing xxx blah bla yxcv zxcv jkl hjkl 123 aaa abc".split())
# Names of things that slots stand for, where the slot's form alone would not show it.
SLOT_NAMES = "city|brand|name|first_?name|last_?name|company|shop_?name|price|date|phone|item|product|headline|heading|title|season|country|author|category|count|unit|intro|slogan|address|e?mail|user_?email|url|stock_?level"
# A repeat stops at the next opening mark, which keeps the search linear on lines of any length.
SLOT = re.compile(
    r"\{\{[^{}]*+\}\}|\{%[^%]*+%\}|[$#]\{[^{}]*+\}|<%[^%]*+%>|<\?(?:php|=)|\[\[[^\[\]]++\]\]|\*\|[^|]++\|\*|(?<!\w)__[A-Za-z][\w.]*?__(?!\w)|(?<![\w%])%[A-Za-z][A-Za-z_]{2,}%(?!\w)|%%[A-Za-z_]+%%|%\([A-Za-z_.]+\)[sd]|<<[^<>]++>>"
    r"|<[A-Z][A-Z_ ]{2,}(?: here)?>|<[A-Za-z_.]+ here>|(?<!\w)@Model\.\w|\(\([a-z_.]+\)\)|\[object Object\]|(?<![\w$#%])\{(?:[A-Za-z_][\w.]*|\d{1,2})\}"
    r"|\[(?:[A-Z][A-Z_ ]{2,}|[a-z]+(?:_[a-z]+)+|(?i:insert|your|add|enter|type|choose|page|site|post|article|company) [^\[\]]++|(?i:" + SLOT_NAMES + r"))\]|\[[a-z][a-z\d_-]*(?: [a-z_]+=\"[^\"\[\]]*+\")++\]"
    r"|(?:^|(?<=[\s:]))NaN(?=$|[\s.,!])|^(?:null|undefined|None)(?= [-|–:]|[.,!]?$)|(?: [-|–:]+ |: )(?:null|undefined)[.,!]?$|(?<= (?:by|is|to|in|of) )(?:null|undefined)(?=$|[.,!]| (?:and|to|EUR|euros?|days?|left)\b)|\b(?:null|undefined) (?:EUR|euros?|USD|€|undefined|null)(?!\w)|Invalid Date\b|^(?i:hello|hi|dear|hallo|guten tag|bonjour|hola) +,"
    r"|\bX{4,}\b|\b(?:XX|xx)[/.-](?:XX|xx)\b|^(?:TODO|FIXME|TBD|TBC)\b",
)
# Titles that nobody has filled in.
TITLE = re.compile(
    r"(?:(?:your|page|post|insert|enter|add|site) )*(?:title|headline|heading|name|text)(?: goes| comes)? here\b|(?:insert|enter|add) (?:a |the |your )?(?:page )?(?:title|headline)\b|(?:untitled|unnamed)(?: (?:page|document|post))?\W*$"
    r"|hier (?:den |ihren |bitte )*(?:titel|überschrift|namen?)\w* (?:eintragen|eingeben|einfügen|einsetzen)|(?:titel|überschrift) (?:hier )?(?:eintragen|eingeben|einfügen)|ihr(?:en)? titel hier"
    r"|(?:votre |le )?titre (?:ici\b|à (?:saisir|compléter|remplir))|(?:saisissez|insérez|entrez) (?:le|un|votre) titre|(?:su |el )?título (?:va )?aquí|(?:escriba|introduzca|inserte|ponga) (?:el|un|su) título"
    r"|(?:ваш )?заголовок (?:здесь|сюда)|(?:введите|вставьте|впишите) (?:заголовок|название)|(?:здесь|сюда) (?:впишите |вставьте )?(?:заголовок|название)",
    re.I,
)
_SLOT_FIRST = re.compile(r"[{\[<%$#@*(]|__|XX|xx|TODO|FIXME|TBD|TBC|undefined|NaN|null|None|Invalid|^\w+(?: \w+)? +,")
#: Wording of lines that speak about slots instead of having one.
ABOUT = re.compile(r"\b(?:templates?|tokens?|a tag such as|themes?|fields?|placeholders?|variables?|brackets|syntax|scripting|prints?|returns|preview|in our mail editor|you write|api|vorlagen?|platzhalter|variablen?|modèles?|gabarits?|balises?|plantillas?|marcador(?:es)?|шаблон\w*|перемен\w+)\b", re.I)
_WORDING = Phrases({k: v.replace("\n", "") for k, v in (("scripts", SCRIPTS), ("filler", SAMPLE), ("status", STATUS))})
APOSTROPHE = chr(0x2019)
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+")
#: Quoted messages are spoken about.
_QUOTED = re.compile(r"[“”„«»]|\"[^\"]+\"")

#: Leading tokens of a leaf of the prefix tree, and the share of tokens that a message has in common with its template.
DEPTH, SIMILAR = 2, 0.7
#: Keys that a founder is looked up by, if one key for each run of tokens is not more already; rows that are handed over at once. No results depend on either.
KEYS, ROWS = 32, 50_000
#: Pages with an error status that a template without known wording stands on, and their share of its pages, from which it is a status message.
LEAST_FAILED, FAILED_SHARE = 3, 0.3
#: Share of a page's words, but for a heading, in messages of one kind.
MOSTLY = 0.5

SAID = "page_id bigint, slot boolean, asked boolean, failed boolean, total int, messages array<struct<key: bigint, n: int, lead: int, reading: string, message: string>>"
LEARNED = "key bigint, template string, verdict string, n_pages bigint"


def masked(sentence: str) -> str:
    """The message of a sentence: lower case, single spaces, a token that holds a digit and does not begin with a letter as <*>."""
    return " ".join("<*>" if any(c.isdigit() for c in t) and not t[0].isalpha() else t for t in sentence.lower().split())


def reading(message: str) -> str:
    """What the wording of a message says: status, filler, scripts or none. Depends on nothing else."""
    w = _WORD.findall(message)
    if not w:
        return "none"
    if len(w) > 3 and sum(x in LOREM for x in w) >= 0.6 * len(w) or sum(x in MASH for x in w) >= 0.7 * len(w):
        return "filler"
    found = _WORDING.matching(message)
    if not found:
        return "none"
    return found[0] if found[0] != "status" or not _QUOTED.search(message) else "none"


def unfilled(line: str) -> bool:
    """The line shows a slot that should have been filled, or a value that failed to render."""
    return bool(_SLOT_FIRST.search(line)) and bool(SLOT.search(line)) and not ABOUT.search(line)


def _clean(line: str) -> str:
    """The line in plain characters, single spaces and straight apostrophes."""
    return " ".join(plain(line).replace(APOSTROPHE, "'").split())


def page_messages(title: str | None, body: list[str], noscript: str | None) -> tuple[bool, bool, int, list[tuple[int, int, int, str, str]]]:
    """(a slot shows, noscript asks for scripts, words, [(key, words, of them in the first of several lines, reading, message)])."""
    body = [_clean(x) for x in body]
    title = _clean(title or "")
    slot = bool(title) and (unfilled(title) or bool(TITLE.match(title))) or any(map(unfilled, body))
    asked = bool(noscript) and "scripts" in _WORDING.matching(_clean(noscript).lower())
    said: dict[str, list[int]] = {}
    for i, line in enumerate(body):
        for sentence in _SENTENCE.split(line):
            n = len(sentence.split())
            if n:
                x = said.setdefault(masked(sentence), [0, 0])
                x[0] += n
                x[1] += n if not i and len(body) > 1 else 0
    return slot, asked, sum(n for n, _ in said.values()), [(xxhash.xxh3_64_intdigest(m) - (1 << 63), n, lead, reading(m), m) for m, (n, lead) in said.items()]


def said_messages(page: DataFrame, page_raw: DataFrame) -> DataFrame:
    """The messages of every page's main body, kept for the passes that follow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, status, title, text, noscript, html in zip(batch.page_id, batch.status, batch.title, batch.text, batch.noscript_text, batch.html, strict=True):
                lines = (text or "").split("\n")
                slot, asked, total, messages = page_messages(title, [lines[k - 1] for k in body_lines(title, text, html)], noscript)
                out.append((page_id, slot, asked, bool(status >= 400), total, messages))
            yield pd.DataFrame(out, columns=["page_id", "slot", "asked", "failed", "total", "messages"])

    rows = pages_with_html(page, page_raw, ["status", "title", "text", "noscript_text"]).where("page_id is not null")
    return cut_lineage(rows.mapInPandas(run, SAID))


class Leaf:
    """The templates of one leaf of the prefix tree. Messages, given in a fixed order, join the first template whose founder has
    enough tokens in common at the same places. Of runs of tokens, more than may differ, some must agree wholly; founders are
    looked up by these. The first ``shared`` tokens are the same in all messages and tell nothing."""

    def __init__(self, size: int, similar: float = SIMILAR, shared: int = 0):
        self.need = similar * size
        most = size - int(-(-self.need // 1))
        # the more runs agree at once, the fewer founders have them in common
        agree = 1
        while most + agree < size - shared and comb(most + agree + 1, most) <= KEYS:
            agree += 1
        cuts = [shared + (size - shared) * k // (most + agree) for k in range(most + agree + 1)]
        runs = [[i for a, b in c for i in range(a, b)] for c in combinations(pairwise(cuts), agree)]
        self.runs = [itemgetter(*r) if r else len for r in runs]
        self.founders, self.shapes, self.words, self.index = [], [], {}, {}

    def add(self, tokens: list[str]) -> int:
        keys = [hash((k, run(tokens))) for k, run in enumerate(self.runs)]
        near = set()
        for key in keys:
            at = self.index.get(key)
            if type(at) is int:
                near.add(at)
            elif at:
                near.update(at)
        for t in sorted(near):
            if sum(map(str.__eq__, self.founders[t], tokens)) >= self.need:
                if any(a != b and a != "<*>" for a, b in zip(self.shapes[t], tokens, strict=True)):
                    self.shapes[t] = [a if a == b else "<*>" for a, b in zip(self.shapes[t], tokens, strict=True)]
                return t
        new = len(self.founders)
        self.founders.append([self.words.setdefault(x, x) for x in tokens])
        self.shapes.append(self.founders[-1])
        for key in keys:
            # most keys have one founder, and a list for each would hold most of the memory
            at = self.index.setdefault(key, new)
            if type(at) is list:
                at.append(new)
            elif at is not new:
                self.index[key] = [at, new]
        return new


def _mined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Templates and verdicts of messages that come leaf by leaf, in the order of their text; all of a leaf have one reading."""
    leaf_name, leaf, read = None, None, "none"
    keys, places, counts, totals, failures = (array("q") for _ in range(5))

    def verdicts() -> Iterator[pd.DataFrame]:
        learned = lambda t: failures[t] >= LEAST_FAILED and failures[t] >= FAILED_SHARE * totals[t]
        told = [read if read != "none" else "status" if learned(t) else None for t in range(len(totals))]
        for a in range(0, len(keys), ROWS):
            rows = [(k, " ".join(leaf.shapes[t]), told[t], n) for k, t, n in zip(keys[a : a + ROWS], places[a : a + ROWS], counts[a : a + ROWS], strict=True) if told[t]]
            yield pd.DataFrame(rows, columns=["key", "template", "verdict", "n_pages"])
        for x in (keys, places, counts, totals, failures):
            del x[:]

    for batch in batches:
        for name, key, reads, message, n, failed in zip(batch.leaf, batch.key, batch.reading, batch.message, batch.n_pages, batch.n_failed, strict=True):
            tokens = message.split(" ")
            if name != leaf_name:
                yield from verdicts()
                leaf_name, leaf, read = name, Leaf(len(tokens), shared=min(DEPTH, len(tokens) - 1)), reads
            t = leaf.add(tokens)
            if t == len(totals):
                totals.append(0)
                failures.append(0)
            totals[t] += n
            failures[t] += failed
            keys.append(key)
            places.append(t)
            counts.append(n)
    yield from verdicts()


def learned_messages(said: DataFrame) -> DataFrame:
    """(key, template, verdict, n_pages) of the messages that are no ordinary text, and the pages that each stands on.

    Only leaves are mined in which a message has telling wording or stands on a page with an error status. All messages of
    a leaf, however many, are sorted and taken together, so templates and verdicts do not depend on the order or partitioning
    of pages or on the size of the leaf. A leaf is one task; it holds its templates in memory, of the messages three numbers each.
    """
    rows = said.select("page_id", "failed", F.explode("messages").alias("m")).select("page_id", "failed", "m.*")
    tokens = F.split("message", " ")
    rows = rows.withColumn("leaf", F.concat_ws(" ", "reading", F.size(tokens), F.slice(tokens, 1, DEPTH)))
    telling = rows.where("failed or reading <> 'none'").select("leaf").distinct()
    counted = rows.join(telling, "leaf", "left_semi").groupBy("leaf", "key", "reading", "message").agg(F.count_distinct("page_id").alias("n_pages"), F.count_distinct(F.when(F.col("failed"), F.col("page_id"))).alias("n_failed"))
    return counted.repartition("leaf").sortWithinPartitions("leaf", "message").mapInPandas(_mined, LEARNED)


def residue_pages(page: DataFrame, page_raw: DataFrame) -> DataFrame:
    """(page_id, reason) of the pages to exclude; reason is slot, filler, status or scripts.

    A page without text and without a demand for scripts is none of them. Null fields count as empty, a null status as no
    error; repeated pages give one row, the least reason should they differ; an empty table gives an empty result.
    """
    said = said_messages(page, page_raw)
    verdicts = learned_messages(said).select("key", "verdict")
    told = salted_join(said.select("page_id", "slot", "total", F.explode("messages").alias("m")).select("page_id", "slot", "total", "m.key", "m.n", "m.lead"), verdicts, ["key"], spread="page_id")
    words = told.groupBy("page_id", "total").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("scripts", "filler", "status")), F.sum("lead").alias("lead_told"))
    lead = said.select("page_id", "total", "slot", "asked", F.aggregate("messages", F.lit(0), lambda a, m: a + m["lead"]).alias("lead")).distinct()
    facts = lead.join(words, ["page_id", "total"], "left").fillna(0, ["scripts", "filler", "status", "lead_told"])
    # the first line is a heading if nothing in it tells; it weighs no more than what the page says
    rest = lambda kind: F.col("total") - F.least(F.when(F.col("lead_told") == 0, F.col("lead")).otherwise(0), F.col(kind))
    mostly = lambda kind: (F.col(kind) > 0) & (F.col(kind) >= F.lit(MOSTLY) * rest(kind))
    reason = (
        F.when(F.col("slot"), "slot")
        .when((F.col("total") == 0) & F.col("asked") | (F.col("scripts") > 0) & (F.col("scripts") >= F.lit(MOSTLY) * F.col("total")), "scripts")
        .when(mostly("filler"), "filler")
        .when(mostly("status"), "status")
    )
    return facts.select("page_id", reason.alias("reason")).where("reason is not null").groupBy("page_id").agg(F.min("reason").alias("reason"))


def message_templates(page: DataFrame, page_raw: DataFrame) -> DataFrame:
    """(template, verdict, n_pages): the classified templates that are not ordinary text, with the sum of the pages of their messages."""
    return learned_messages(said_messages(page, page_raw)).select("template", "verdict", "n_pages").groupBy("template", "verdict").agg(F.sum("n_pages").alias("n_pages"))
