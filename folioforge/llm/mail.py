"""Newly written text of mail messages (3): quoted history, signatures and legal text are found and subtracted."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.lines import GIVEN
from folioforge.session import cut

ROWS = 500

# --- fixed values: phrases of mail programs and mail systems, in four languages ---
CLOSINGS = frozenset(
    """best|best regards|best wishes|all best|all the best|kind regards|warm regards|regards|many thanks|thanks|thank you|thanks again|cheers|warmly|yours|yours sincerely|yours truly
    |yours faithfully|sincerely|talk soon|speak soon|take care|respectfully|with thanks|mit freundlichen grüßen|mit freundlichem gruß|freundliche grüße|viele grüße|beste grüße|liebe grüße|herzliche grüße
    |mfg|gruß|schöne grüße|cordialement|bien cordialement|bien à vous|amicalement|salutations|meilleures salutations|sincères salutations|saludos|un saludo|saludos cordiales|atentamente|cordialmente
    |un cordial saludo|un abrazo|gracias|merci|danke|vielen dank""".replace("\n", "").replace("    ", "").split("|")
)
DEVICE = re.compile(
    r"^(?:sent (?:from|via|with|using) (?:my|an?|the)? ?[\w' ]{0,30}(?:phone|tablet|mobile|mail|device|pad|android|blackberry|outlook|app)\b.{0,60}"
    r"|sent from my .{2,60}|typed with thumbs.{0,30}|(?:von unterwegs|von meinem .{2,40}) gesendet.{0,20}|get (?:the mobile app|outlook|.{2,20} app) for \w+"
    r"|envoyé (?:de|depuis) mon .{2,40}|enviado desde mi .{2,40}|please excuse (?:typos|brevity).{0,30})\W*$"
)
LEGAL = re.compile(
    r"\bconfidentiality notice\b|\b(?:is|are|be)(?: strictly)? (?:privileged|private|confidential)\b(?: and\b|$|\.)|\b(?:privileged|private|confidential) and (?:confidential|private|privileged|intended)\b"
    r"|\breceived (?:it|this(?: \S+)?) in error\b|\b(?:any|unauthori[sz]ed) (?:\w+ or )?(?:use|copying|disclosure|distribution)\b.{0,40}\b(?:prohibited|forbidden|not permitted)\b"
    r"|\baccepts? no liability\b|\bmay monitor traffic\b|\bauthorised and supervised by\b|\bregister no\. ?\d|\bregistered office:|\bconsider the environment before printing\b"
    r"|\bpast performance says little\b|\bis an offer to buy or sell\b|\bviews are the sender's own\b|^\W*classified: |\bvertraulich und nur für\b|\birrtümlich erhalten\b"
    r"|\bmessage est confidentiel\b|\bdiffusion est interdite\b|\bmensaje es confidencial\b|\brecibido (?:este mensaje )?por error\b|\bintended only for\b.{0,40}\b(?:addressee|recipient)"
)
BANNER = re.compile(r"^\W*(?:external\b|caution: |warning: external|you don't often get e-?mail from|this (?:message|e-?mail) (?:came|originated) from outside|extern\w*: )")
_HEAD = re.compile(
    r"^(?:from|von|de|expéditeur|remitente|date|datum|fecha|sent|gesendet|envoyé|enviado(?: el)?|to|an|à|para|cc|bcc|kopie|subject|betreff|objet|asunto|reply-to|antwort an)\s?:(?:\s|$)", re.IGNORECASE
)
_HEAD_FIRST = re.compile(r"^(?:from|von|de|expéditeur|remitente)\s?:\s", re.IGNORECASE)
_DIVIDER = re.compile(r"^\W*(?:-{2,}\s*)?(?:original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|message transféré|mensaje original|mensaje reenviado|begin forwarded message:?)(?:\s*-{2,})?\W*$", re.IGNORECASE)
_INTRO = re.compile(
    r"^(?:on\b.{6,200}\b(?:wrote|writes)\s?:|am\b.{6,200}\bschrieb\b.{0,120}:|le\b.{6,200}\ba écrit\s?:|el\b.{6,200}\bescribió\s?:|.{2,80} (?:said|wrote) on \d.{4,40}:|.{3,80} \(\d{1,2}\.? [a-zéû]{3,9}\.? \d{4}\)\s?:"
    r"|\d{4}-\d\d-\d\d \d\d:\d\d\S* ?(?:gmt|utc|[+-]\d{4})?,? .{3,120}:)$",
    re.IGNORECASE,
)
_INTRO_START = re.compile(r"^(?:on|am|le|el) .{0,12}(?:\d|mon|tue|wed|thu|fri|sat|sun)|^\d{4}-\d\d-\d\d \d\d:\d\d", re.IGNORECASE)
# --- end of fixed values ---

_PREFIX = re.compile(r"^(?:[ \t]{0,3}[>»|]|[ \t]{4,}\S|\t\S)")
_INDENT = re.compile(r"^(?: {4,}|\t)[^\s]")
_MARK = re.compile(r"^[>»|\s]+")
_DELIMITER = re.compile(r"^(?:-- ?|—|–|_{3,}|={3,}|\*{3,}|-{3,}|\*(?: \*){2,}|~{3,}|#{3,})$")
_NAME = re.compile(r"^(?:(?:Dr|Prof|Sir|Mr|Mrs|Ms)\.? )?[^\W\d_]+(?:[ .'’-]{1,2}[^\W\d_]+\.?){0,3}\W{0,2}$")
_CONTACT = re.compile(r"^(?:t|tel|m|f|fax|phone|mob|mobile|cell|telefon|tél)\b\W{0,3}[+\d(]|^(?:https?://|www\.)\S+$|^\S+@\S+\.\w+$|\d{3}[ -]\d{3,4}|, floor \d|^\d+ [A-Z]\w+ (?:street|lane|road|row|avenue)", re.IGNORECASE)
_TITLE = re.compile(
    r"^(?:senior |junior |deputy |chief |managing |executive |assistant |associate |head of |director of |vice |acting )*(?:analyst|manager|director|editor|translator|assistant|professor|fellow|partner|officer|economist|president|reporter|correspondent|counsel|secretary|desk|portfolio|research|head|lecturer|trader|consultant|advisor|adviser|engineer|chair)\b.{0,60}$",
    re.IGNORECASE,
)


def is_name(line: str, given: bool = False) -> bool:
    """Whether a line is a person's name alone; given: one word counts only when it is a given name."""
    s = line.strip(" .,")
    parts = s.split()
    if not parts or len(parts) > 4 or len(s) > 45 or not all(p[0].isupper() for p in parts) or not _NAME.match(s):
        return False
    return parts[0].lower().strip(".") in GIVEN or (len(parts) >= 2 and not given and all(p.replace(".", "").replace("-", "").isalpha() for p in parts) and line.strip()[-1:] not in ".!?")


def _blocks(flags: list[bool], lines: list[str]) -> Iterator[tuple[int, int]]:
    """(first, end) of each run of open lines that are not blank."""
    start = -1
    for i, line in enumerate(lines):
        if not flags[i] and line.strip():
            if start < 0:
                start = i
        elif start >= 0:
            yield start, i
            start = -1
    if start >= 0:
        yield start, len(lines)


def _introduction(lines: list[str], i: int) -> int:
    """How many lines from i on introduce an earlier message: an attribution of up to three lines, a divider, or a header block; 0 if none do."""
    s = lines[i].strip()
    if not s:
        return 0
    if _DIVIDER.match(s):
        j = i + 1
        while j < len(lines) and (_HEAD.match(lines[j].strip()) and not (_HEAD_FIRST.match(lines[j].strip()) and j > i + 2) or not lines[j].strip() and j == i + 1):
            j += 1
        return j - i
    if _HEAD_FIRST.match(s):
        j = i + 1
        while j < len(lines) and _HEAD.match(lines[j].strip()) and not _HEAD_FIRST.match(lines[j].strip()):
            j += 1
        if j - i >= 3:
            return j - i
    if _DELIMITER.match(s) and i + 1 < len(lines) and _HEAD_FIRST.match(lines[i + 1].strip()):
        n = _introduction(lines, i + 1)
        return n + 1 if n else 0
    if _INTRO.match(s):
        return 1
    if _INTRO_START.match(s):
        joined = s
        for k in (1, 2):
            if i + k >= len(lines) or not lines[i + k].strip():
                break
            joined += " " + lines[i + k].strip()
            if _INTRO.match(joined):
                return k + 1
    return 0


def not_new(text: str) -> list[bool]:
    """For each line of a message whether its sender did not newly write it, by the signs the message itself bears.

    An introduction (attribution, divider or header block) opens earlier mail. When
    the lines after it bear a quote mark or an indent, those and the lines wrapped out
    of them are earlier; else everything to the end is. Of what is left, closing
    formulas with the lines below them, signatures, device lines, legal text and
    warnings of the mail system are marked.
    """
    lines = text.split("\n")
    n = len(lines)
    gone = [False] * n
    i = 0
    indented = False
    while i < n:
        if gone[i] or not lines[i].strip():
            i += 1
            continue
        if indented and _INDENT.match(lines[i]):
            gone[i] = True
            i += 1
            # a line wrapped out of its indent
            while i < n and lines[i].strip() and not _INDENT.match(lines[i]) and i + 1 < n and _INDENT.match(lines[i + 1]):
                gone[i] = True
                i += 1
            continue
        if _PREFIX.match(lines[i]) and lines[i].lstrip()[:1] in ">»|":
            gone[i] = True
            i += 1
            # a line wrapped out of its quote mark
            while i < n and lines[i].strip() and not _PREFIX.match(lines[i]) and not _introduction(lines, i):
                gone[i] = True
                i += 1
            continue
        k = _introduction(lines, i)
        if not k:
            i += 1
            continue
        for j in range(i, i + k):
            gone[j] = True
        first = next((j for j in range(i + k, n) if lines[j].strip()), n)
        if first < n and _PREFIX.match(lines[first]):
            indented = indented or bool(_INDENT.match(lines[first]))
            i = first
        else:
            for j in range(i, n):
                gone[j] = True
            break
    _close(lines, gone)
    return gone


def _close(lines: list[str], gone: list[bool]) -> None:
    """Mark warnings, legal text, device lines, signatures and closing formulas among the lines still open."""
    n = len(lines)
    blocks = list(_blocks(gone, lines))
    for a, b in blocks:
        joined = re.sub(r"\s+", " ", " ".join(lines[a:b])).strip().lower()
        if BANNER.match(joined):
            for i in range(a, b):
                gone[i] = True
            continue
        for i in range(a, b):
            low = lines[i].strip().lower()
            if DEVICE.match(low) or BANNER.match(low):
                gone[i] = True
        if LEGAL.search(joined):
            # legal text runs from a delimiter, or its block's first line, to the end of the block
            start = next((i for i in range(a, b) if _DELIMITER.match(lines[i].strip())), a)
            for i in range(start, b):
                gone[i] = True
    # closing blocks: after the last open line nothing newly written may follow
    blocks = list(_blocks(gone, lines))
    for at, (a, b) in enumerate(blocks):
        for i in range(a, b):
            s = lines[i].strip()
            bare = s.lower().rstrip(",.! ")
            rest = [x.strip() for x in lines[i + 1 : b] if x.strip()]
            if bare in CLOSINGS and (rest and all(_signs(x) for x in rest) or not rest and (at + 1 == len(blocks) or all(_signs(x.strip()) for x in lines[blocks[at + 1][0] : blocks[at + 1][1]]) or _separate(lines, b, blocks[at + 1][0], gone))):
                for j in range(i, b):
                    gone[j] = True
                if not rest and at + 1 < len(blocks):
                    c, d = blocks[at + 1]
                    if all(_signs(x.strip()) for x in lines[c:d]):
                        for j in range(c, d):
                            gone[j] = True
                break
            if _DELIMITER.match(s) and (not rest or all(_signs(x) for x in rest)):
                for j in range(i, b):
                    gone[j] = True
                break
    blocks = list(_blocks(gone, lines))
    for at, (a, b) in enumerate(blocks):
        own = [x.strip() for x in lines[a:b]]
        last = at + 1 == len(blocks) or gone[b : blocks[at + 1][0]].count(True) > 0
        if last and is_name(own[0], given=len(own) == 1) and all(_signs(x) for x in own[1:]) and len(own) <= 5 and (at > 0 or len(blocks) == 1 or a > 0):
            if own[0].endswith((",", ":", "-")):
                continue
            for i in range(a, b):
                gone[i] = True
        elif last:
            # a signature right below the last sentence
            i = b - 1
            while i > a and (_CONTACT.search(lines[i].strip()) or _TITLE.match(lines[i].strip())):
                i -= 1
            if i > a and is_name(lines[i]) and lines[i].strip()[-1:].isalpha() and lines[i - 1].rstrip()[-1:] in ".!?”\"»)":
                for j in range(i, b):
                    gone[j] = True
    for i in range(n):
        if not lines[i].strip():
            gone[i] = False


def _separate(lines: list[str], a: int, b: int, gone: list[bool]) -> bool:
    return any(gone[i] and lines[i].strip() for i in range(a, b))


def _signs(s: str) -> bool:
    """Whether a line may stand in a signature: a name, a title, a contact or a delimiter."""
    return is_name(s) or bool(_CONTACT.search(s)) or bool(_TITLE.match(s)) or bool(_DELIMITER.match(s)) or (len(s) <= 60 and s[-1:] not in ".!?,;:" and len(s.split()) <= 6)


_SPLIT = re.compile(r"(?<=[.!?])[\"”’)]*\s+")
_WORDS = re.compile(r"[^\W\d_]+")
SHORT = 40  # letters; a shorter sentence is no pattern, as people type the same short phrases anew
CLOSING_LETTERS = 25
RUN = 80  # letters; merged matches under this are no earlier mail unless they are a closing block, as a single sentence may be typed anew
ANCHOR = 4  # words; a pattern is sought by its first words, so one of fewer words is none


def _words(s: str) -> list[str]:
    return _WORDS.findall(s.lower())


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def anchors(words: list[str]) -> list[int]:
    """Hashes of all runs of ``ANCHOR`` words."""
    return [_hash(" ".join(words[i : i + ANCHOR])) for i in range(len(words) - ANCHOR + 1)]


def patterns(text: str, gone: list[bool]) -> list[list[str]]:
    """Patterns a message gives to the automata of later messages, as words: its newly written sentences and its closing blocks."""
    lines = text.split("\n")
    out = []
    for a, b in _blocks(gone, lines):
        own = [_words(x) for x in _SPLIT.split(" ".join(_MARK.sub("", x) for x in lines[a:b]))]
        out += [w for w in own if sum(map(len, w)) >= SHORT]
    closing: list[str] = []
    for x, g in zip([*lines, ""], [*gone, False], strict=True):
        if g and _signs(x.strip()) and not _PREFIX.match(x):
            closing.append(x)
        else:
            if closing and (closing[0].strip().lower().rstrip(",.! ") in CLOSINGS or _DELIMITER.match(closing[0].strip()) or is_name(closing[0])):
                out.append(_words(" ".join(closing)))
            closing = []
    return [w for w in out if len(w) >= ANCHOR and sum(map(len, w)) >= CLOSING_LETTERS]


def last_block(text: str, gone: list[bool]) -> str:
    """The letters of the block a message's newly written text ends with when it has the shape of a closing block: two to seven short lines that are no sentences; else nothing."""
    lines = text.split("\n")
    block: tuple[int, int] | None = None
    for block in _blocks(gone, lines):
        pass
    if block is None or not 2 <= block[1] - block[0] <= 7:
        return ""
    own = [x.strip() for x in lines[block[0] : block[1]]]
    letters = "".join(_words(" ".join(own)))
    return letters if all(len(x) <= 60 and x[-1:] not in ".!?;:" for x in own) and len(letters) >= CLOSING_LETTERS // 2 else ""


def scan(text: str, gone: list[bool], known: list[str], closings: list[str]) -> list[bool]:
    """``gone`` and, besides, the lines that an automaton over known patterns covers.

    known: letters of earlier sentences and closing blocks of the thread; closings: letters of
    blocks that end several of its messages. The message is read as letters; overlapping and touching matches
    are merged. A line is subtracted when nine tenths of its letters lie in merged
    intervals; a merged interval of fewer than ``RUN`` letters counts for whole lines of a signature only.
    """
    if not known and not closings:
        return gone
    automaton = ahocorasick.Automaton()
    for k in (*known, *closings):
        automaton.add_word(k, len(k))
    automaton.make_automaton()
    lines = text.split("\n")
    parts = ["".join(_words(_MARK.sub("", x))) for x in lines]
    intervals: list[list[int]] = []
    for end, size in automaton.iter("".join(parts)):
        a, b = end - size + 1, end + 1
        while intervals and a <= intervals[-1][1]:
            a = min(a, intervals.pop()[0])
        intervals.append([a, b])
    starts, at = [], 0
    for part in parts:
        starts.append(at)
        at += len(part)
    whole = set(closings)
    good = []
    for a, b in intervals:
        inside = [i for i, part in enumerate(parts) if part and starts[i] < b and starts[i] + len(part) > a]
        if b - a >= RUN or "".join(parts[i] for i in inside) in whole or all(_signs(_MARK.sub("", lines[i]).strip()) for i in inside):
            good.append((a, b))
    out = list(gone)
    for i, part in enumerate(parts):
        if part and not out[i]:
            covered = sum(max(0, min(b, starts[i] + len(part)) - max(a, starts[i])) for a, b in good)
            out[i] = covered * 10 >= 9 * len(part)
    return out


MAIL = r"(?i)\.(?:eml|mbox)\s*$"


def messages(extracts: DataFrame) -> DataFrame:
    """(extract_id, ordinal, thread, text) of each message of a mail file; thread: whether the file has several. Other files, null documents and null texts have none."""
    each = extracts.where(F.col("original").rlike(MAIL)).select("extract_id", (F.size("documents") > 1).alias("thread"), F.posexplode("documents"))
    return each.where(F.col("col.text").isNotNull()).select("extract_id", F.coalesce("col.ordinal", "pos").alias("ordinal"), "thread", F.col("col.text").alias("text"))


def _mapped(fn, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = [fn(*row) for row in zip(*(c.to_pylist() for c in batch.slice(start, ROWS).columns), strict=True)]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


_READ = "extract_id long, ordinal int, gone array<int>, given array<struct<anchor:long,pattern:string>>, held array<long>, last string"


def read(mails: DataFrame) -> DataFrame:
    """One row per message: the lines its own signs mark, the patterns it gives, the anchors it holds and its last block; written once to the shared folder.

    Messages that stand alone in their file give and hold none.
    """

    def one(extract_id, ordinal, thread, text):
        gone = not_new(text)
        nos = [i for i, g in enumerate(gone) if g]
        if not thread:
            return extract_id, ordinal, nos, [], [], ""
        given = {"".join(w): _hash(" ".join(w[:ANCHOR])) for w in patterns(text, gone)}
        held = anchors(_words(" ".join(_MARK.sub("", x) for x in text.split("\n"))))
        return extract_id, ordinal, nos, [{"anchor": h, "pattern": k} for k, h in given.items()], list(set(held)), last_block(text, gone)

    given = pa.list_(pa.struct([("anchor", pa.int64()), ("pattern", pa.string())]))
    schema = pa.schema([("extract_id", pa.int64()), ("ordinal", pa.int32()), ("gone", pa.list_(pa.int32())), ("given", given), ("held", pa.list_(pa.int64())), ("last", pa.string())])
    return cut(mails.select("extract_id", "ordinal", "thread", "text").mapInArrow(_mapped(one, schema), _READ), "mail")


def earlier(messages_read: DataFrame) -> DataFrame:
    """(extract_id, ordinal, known, closings): for each message the patterns of earlier messages of its file that may stand in it, and the closing blocks it shares with others.

    A message's automaton needs only patterns that it may hold. They are found by an
    equi-join of the first words of each pattern with all runs of as many words
    of later messages, which misses none wherever it stands, so that a file of any length is never gathered. A block that ends two messages of a
    file is a closing block of their sender.
    """
    given = messages_read.select("extract_id", "ordinal", F.explode("given").alias("g")).groupBy("extract_id", "g.anchor", "g.pattern").agg(F.min("ordinal").alias("first"))
    held = messages_read.select("extract_id", "ordinal", F.explode("held").alias("anchor"))
    known = held.join(given, ["extract_id", "anchor"]).where("ordinal > first").groupBy("extract_id", "ordinal").agg(F.collect_set("pattern").alias("known"))
    last = messages_read.where("last <> ''").select("extract_id", "ordinal", "last")
    shared = last.groupBy("extract_id", "last").agg(F.count_distinct("ordinal").alias("n")).where("n > 1").drop("n")
    closings = last.join(shared, ["extract_id", "last"]).groupBy("extract_id", "ordinal").agg(F.collect_set("last").alias("closings"))
    return known.join(closings, ["extract_id", "ordinal"], "full")


def marked(extracts: DataFrame) -> DataFrame:
    """(extract_id, ordinal, gone): for each message the numbers of the lines that its sender did not newly write, blank lines left out.

    Messages that hold something of an earlier one are scanned by its automaton; the
    signs within a message stand for what no earlier message of the file can show.
    """
    mails = messages(extracts)
    seen = read(mails)
    met = cut(earlier(seen), "mail-known")

    def scanned(extract_id, ordinal, text, gone, known, closings):
        lines = text.split("\n")
        marks = [False] * len(lines)
        for i in gone:
            marks[i] = True
        found = scan(text, marks, known or [], closings or [])
        return extract_id, ordinal, [i for i, (x, g) in enumerate(zip(lines, found, strict=True)) if g and x.strip()]

    schema = pa.schema([("extract_id", pa.int64()), ("ordinal", pa.int32()), ("gone", pa.list_(pa.int32()))])
    key = ["extract_id", "ordinal"]
    own = seen.select("extract_id", "ordinal", "gone")
    again = mails.select("extract_id", "ordinal", "text").join(met, key).join(own, key).select("extract_id", "ordinal", "text", "gone", "known", "closings")
    return own.join(met.select(*key), key, "left_anti").unionByName(again.mapInArrow(_mapped(scanned, schema), "extract_id long, ordinal int, gone array<int>"))


def lines_not_new(extracts: DataFrame) -> DataFrame:
    """(extract_id, ordinal, line_no) of every line of a mail message that is not blank and that its sender did not newly write."""
    return marked(extracts).select("extract_id", "ordinal", F.explode("gone").alias("line_no"))


def new_text(extracts: DataFrame) -> DataFrame:
    """(extract_id, ordinal, text): each mail message with only its newly written lines, blank runs joined."""
    kept = F.expr("filter(transform(split(text, '\n', -1), (x, i) -> if(array_contains(gone, i), null, x)), x -> x is not null)")
    both = messages(extracts).join(marked(extracts), ["extract_id", "ordinal"])
    return both.select("extract_id", "ordinal", F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n\s*\n\s*", "\n\n"), r"^\s+|\s+$", "").alias("text"))
