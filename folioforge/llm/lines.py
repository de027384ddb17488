"""Line-level reading of captured web pages, shared by the page operators.

A page body is plain text. Its lines are read as a tree (page > container >
line): sidebars and comment threads are containers opened by a header
line, a run of labels or of link-like lines is a container of its own, and every
run of text between those is a column. Lines pass points for length and commas up
to their container, which keeps them less its link density: the share of its
characters in lines that look like links. A line does so when it returns on many
pages of its site, when it has the shape of a label, or when a phrase names it.
"""

from __future__ import annotations

import html
import re

# --- fixed values: phrases by which page furniture and residue is recognised, in four languages ---

_INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
_HIDDEN = re.compile(f"[{_INVISIBLE}]")

CONSENT = (
    r"(?:uses|use|utilise|verwendet|usa|utiliza|nutzt) (?:des |de |las )?cookies",
    r"keeps a record of your visit",
    r"privacy matters to us",
    r"store small files on your device",
    r"guardamos datos en su dispositivo",
    r"déposons des traceurs",
    r"(?:wir und unsere) \d+ partner",
    r"read the full policy before",
    r"by continuing to browse",
    r"accept all or manage",
)
LEGAL = (
    r"all rights reserved",
    r"alle rechte vorbehalten",
    r"tous droits réservés",
    r"todos los derechos reservados",
    r"^(?:©|\(c\) ?\d)",
    r"registered under licen[cs]e",
    r"reproduction in whole or (?:in )?part",
    r"^terms of (?:use|service)\b",
    r"is investment advice; seek",
    r"nothing on this page is",
    r"views expressed here are the author",
    r"propos tenus ici n'engagent",
    r"opiniones aquí vertidas",
    r"gibt allein die meinung",
    r"^impressum ",
    r"^mentions légales",
    r"^aviso legal",
    r"^quotes delayed by",
    r"^cours différés",
    r"^kurse mindestens",
    r"^cotizaciones con",
    r"comments are moderated",
    r"do not sell my data",
    r" media house, \d+ ",
    r"please consider the environment",
)
PROMPT = (
    r"^share this (?:piece|article|story|page) ",
    r"^comparte este",
    r"^partagez cet",
    r"^diesen beitrag teilen",
    r"^enjoying this\?",
    r"gift the article",
    r"^sign up for (?:the|our) .{0,60}(?:briefing|newsletter)",
    r"\bfree articles left\b",
    r"^noch \d+ freie artikel\b",
    r"^(?:le|te|les) quedan \d+ artículos\b",
    r"^il vous reste \d+ articles?\b",
    r"^(?:sigue|siga|continúa|continúe) leyendo (?:tras|después)\b",
    r"^(?:la )?suite (?:de l'article )?après (?:la|l')\b",
    r"^lire la suite après\b",
    r"^weiterlesen nach\b",
    r"^contenido patrocinado\b",
    r"^contenu (?:sponsorisé|proposé|partenaire)\b",
    r"^mit freundlicher unterstützung\b",
    r"^(?:anzeige|werbung) von\b",
    r"^sponsored (?:content )?by\b",
    r"^sign in \|",
    r"^anmelden \|",
    r"^se connecter \|",
    r"^iniciar sesión \|",
    r"^subscribe (?:for|to|now)\b.{0,40}$",
    r"^download our app",
    r"^got a tip\?",
    r"^une remarque ?\?",
    r"^¿una sugerencia\?",
    r"^hinweise an die redaktion",
    r"^listen to this (?:article|story)",
    r"^artikel anhören",
    r"^écouter ?\(",
    r"^escuchar ?\(",
    r"^escuchar (?:este|el) artículo",
    r"^print\s+e-?mail\s+save",
    r"^(?:toggle|enable|switch to) dark mode",
    r"^skip to (?:main )?content",
    r"^zum inhalt springen",
    r"^aller au contenu",
    r"^saltar al contenido",
    r"^(?:back to top|nach oben|haut de page|volver arriba)$",
    r"^(?:story|article) continues below",
    r"^weiter nach der werbung",
    r"^la suite après la publicité",
    r"^(?:la noticia |el artículo )?(?:continúa|sigue) (?:después|tras)",
    r"^(?:advertisement|anzeige|werbung|publicité|publicidad|menu|menü|menú|sponsored|promoted)$",
    r"^(?:show|view|load) \d+ more comments",
    r"^\d+ weitere kommentare",
    r"^voir \d+ autres commentaires",
    r"^ver \d+ comentarios",
    r"^about us \|",
    r"^über uns \|",
    r"^qui sommes-nous",
    r"^quiénes somos",
    r"[—–-] edition: \w+$",
    r"^to read more of my columns",
    r"^(?:this page is |this article is |)(?:brought to you|presented|sponsored) by ",
    r"^(?:präsentiert von|con el patrocinio de|patrocinado por|en partenariat avec|avec le soutien de) ",
)
CREDIT = (
    r"^image credit\b",
    r"^.{0,250}\[\+\]",
    r"\(photo by .{3,120}\)?$",
    r"\bpicture: [^.]{3,60}$",
    r"\([^()]{3,60} / [^()]{3,60} images\)$",
    r"^(?:foto|photo|crédit photo|bild|imagen)\s?:",
    r"^additional reporting by ",
    r"^first printed in the ",
    r"teaches finance and has written for",
    r"^follow .{3,60} on \w+ for more",
    r"\| (?:senior |staff |guest )?columnist\b",
    r"\| (?:senior |staff |guest )?editor\b",
    r"\| (?:senior |staff |guest )?writer\b",
    r"\| (?:senior |staff |guest )?contributor\b",
    r"\| (?:senior |staff |guest )?correspondent\b",
    r"^by [^.!?]{3,60}, (?:senior |staff )?(?:contributor|columnist)$",
    r"^published (?:on )?(?:\d|[a-z]{3,9} \d)",
    r"^publicado el ",
    r"^publié le ",
    r"^veröffentlicht am ",
    r"^stand: ",
    r" on \d{4}/\d\d/\d\d\. \w+/\w",
    r"^(?:updated|last updated) (?:on )?(?:\d|[a-z]{3,9} \d)",
)
TEASER = (
    r"^(?:related|more|read more|see also|read also|read next|also on this topic|don't miss)\s?(?:[:|—–»]|-\s)",
    r"^(?:mehr|lesen sie auch|siehe auch|auch interessant)\s?(?:[:|—–»]|-\s)",
    r"^(?:lire aussi|à lire|voir aussi|sur le même sujet)\s?(?:[:|—–»]|-\s)",
    r"^(?:lea también|vea también|más|ver también|también)\s?(?:[:|—–»]|-\s)",
)
SIDEBAR = (
    r"^(?:most read|most popular|trending now|trending|editor'?s picks|related stories|related articles|more from this author|more stories|recommended|you may also like)$",
    r"^(?:meistgelesen|mehr zum thema|mehr vom autor|empfehlungen|das könnte sie interessieren)$",
    r"^(?:les plus lus|à lire aussi|sur le même sujet|du même auteur)$",
    r"^(?:lo más leído|te puede interesar|del mismo autor|relacionados|más noticias)$",
)
COMMENT = (
    r"\b\d+ (?:minutes?|hours?|days?|weeks?) ago\b.{0,20}\b(?:reply|report)\b",
    r"\bvor \d+ (?:minuten|stunden|tagen)\b",
    r"\bil y a \d+ (?:minutes?|heures?|jours?)\b",
    r"\bhace \d+ (?:minutos?|horas?|días?)\b",
)
BYLINE = re.compile(r"^(?:by|par|por|von) (?:(?:dr|prof|sir|mr|ms|mrs)\.? )?[^\W\d_][\w.'’-]*(?: [^\W\d_][\w.'’-]*){1,3}$")
NAV = set(
    """about account advertise agenda analysis archiv archive archives archivo article articles abo abonnement banking books business buscar
    careers columns comment companies contact contacto commodities cuenta culture deals economy economía économie editor edition education
    empresas energy entreprises environment events finance fonds fondos funds health help home inicio investing jobs kontakt konto latest letters
    life login magazine märkte marchés markets media meinung mercados money more most my mein mi mon compte news newsletters opinion opinión opinions
    people podcasts politics popular press profile rates read recherche register reports reviews science search sección section sections sign
    sports startseite subscribe suche style subscription suscripción techno technik technology tecnología termine top topics travel
    trending unternehmen video videos vidéos weather wirtschaft work world monde mundo welt accueil office""".split()
)

RESIDUE = (
    r"^\W*(?:http )?(?:error|status|fehler|erreur)\W{1,3}\d{3}\b",
    r"^\W*\d{3}\W+(?:bad|forbidden|not found|gateway|service|internal|too many|unauthorized|gone|error)",
    r"\bforbidden\W{0,3}(?:\(?\d{3}\)?)?\W*$",
    r"\bnot found on this server\b",
    r"\b(?:page|address|story|article) you (?:are|were) looking for\b",
    r"page not found",
    r"^not found(?: \(?\d{3}\)?)?$",
    r"^no such (?:key|page|file)\b",
    r"^ray [0-9a-f]{8,}",
    r"request id [0-9a-f]{6,}",
    r"if the problem persists",
    r"página que busca ya no existe",
    r"página no encontrada",
    r"page (?:introuvable|non trouvée)",
    r"page demandée a été (?:déplacée|supprimée)",
    r"seite (?:wurde )?nicht gefunden",
    r"inhalt ist (?:leider )?nicht mehr verfügbar",
    r"internal server error",
    r"interner serverfehler",
    r"erreur interne",
    r"error interno",
    r"bad gateway",
    r"gateway time-?out",
    r"connection timed out",
    r"timed out responding",
    r"service (?:temporarily )?unavailable",
    r"service (?:est )?(?:momentanément |temporairement )indisponible",
    r"servicio no (?:está )?disponible",
    r"dienst (?:ist )?(?:derzeit |zurzeit )?nicht verfügbar",
    r"authorization required",
    r"have permission to (?:view|access) ",
    r"access denied",
    r"(?:access|request)\b.{0,40} (?:has been|was) denied",
    r"(?:access|request)\b.{0,40} (?:has been|was) blocked",
    r"has been denied for your",
    r"acceso denegado",
    r"zugriff verweigert",
    r"accès refusé",
    r"establishing a database connection",
    r"server took too long",
    r"requested (?:address|url|page) was not found",
    r"nothing to see at this address",
    r"something went wrong on our end",
    r"please try again in \d+ minutes",
    r"unable to load content",
    r"story has been taken down",
    r"link has expired",
    r"return to the front page or ",
    r"^reference (?:number|id|code): ?[0-9a-f-]{6,}",
    r"^traceback: ",
    r"failed opening required file",
    r"undefined index:",
    r"fatal error:",
    r"parse error:",
    r"syntax error:",
    r"too many requests",
    r"bad request",
    r"^gone$",
    r"(?:enable|activate|turn on|allow|active|activez|aktivieren sie|habilite) javascript",
    r"javascript (?:is|seems to be) (?:disabled|off|required)",
    r"javascript (?:zu )?(?:aktivieren|einschalten|activer|activar|habilitar|para ver|pour)",
    r"needs? (?:javascript|scripts) ",
    r"scripts switched on",
    r"script blocker",
    r"accepts scripts",
    r"checking your browser",
    r"verify (?:that )?you are (?:a )?human",
    r"security check to ",
    r"confirm you are a person",
    r"browser does not support",
    r"^noscript\b",
    r"placeholder (?:copy|text)",
    r"before publishing",
    r"^(?:loading|redirecting|please wait)$",
    r"^(?:insert story|text goes here|body copy to come)\b",
    r"^sample paragraph\b",
    r"^dummy text\b",
    r"your content will appear in this space",
    r"filler text sits here",
    r"^(?:(\w{1,6})(?: \1){2,})$",
    r"^(?:asdf|qwerty|blah|test|foo)(?: (?:asdf|qwerty|blah|test|foo))+$",
)
FILLER = set(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad
    minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit
    voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt
    mollit anim id est laborum curabitur pretium tincidunt lacus gravida orci odio a vestibulum vivamus pellentesque mauris""".split()
)
# --- end of fixed values ---

PLACEHOLDER = re.compile(
    r"\{\{[^{}]*\}\}|<%=?[^%<>]*%>|\$\{[^{}]*\}|%%\w+%%|\{[a-z_]\w*\}|__[A-Za-z]\w*__|@@\w+@@|<[a-z]+(?:[-_ ][a-z]+)*>|\$[A-Za-z]\w*\$|\bXX[A-Za-z]+XX\b"
    r"|\[(?:insert [^\[\]]*|[A-Z][A-Z _]{1,40}|[^\[\]]* TK)\]|\([^()]{1,40} TK\)",
)
_STRAY = re.compile(r"^\W*(?:\{\{[^{}]*\}\}|<%=?[^%<>]*%>|\$\{[^{}]*\}|%%\w+%%|@@\w+@@|<[a-z]+(?:[-_ ][a-z]+)*>|\{\w+\}|\[[^\[\]]{2,60}\]|__\w+__|\$\w+\$)\W*$")
_SIDE = re.compile("|".join(SIDEBAR))
_THREAD = re.compile("|".join(COMMENT))


def plain_runs(pattern: str) -> list[str]:
    """The runs of plain characters that every match of a pattern must hold; groups and classes are left out."""
    runs, run, i, depth = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            runs.append(run)
            run, i = "", i + 2
            continue
        if c in "([":
            depth += 1
        if depth:
            if c in ")]":
                depth -= 1
            runs.append(run)
            run = ""
        elif c in "?*{":
            runs.append(run[:-1])
            run = ""
            if c == "{":
                i = pattern.index("}", i)
        elif c in ".^$+|})]":
            runs.append(run)
            run = ""
        else:
            run += c
        i += 1
    return [r for r in (*runs, run) if r]


def literal(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern must hold."""
    return max(plain_runs(pattern), key=len, default="")


class Phrases:
    """Whether any of many patterns is found in a text: those anchored at the start by one match, the others by an automaton over their literals."""

    def __init__(self, *groups: tuple[str, ...]) -> None:
        import ahocorasick

        patterns = [p for group in groups for p in group]
        self.start = re.compile("|".join(f"(?:{p[1:]})" for p in patterns if p[0] == "^"))
        self.automaton = ahocorasick.Automaton()
        by_literal: dict[str, list[str]] = {}
        for p in patterns:
            if p[0] != "^":
                by_literal.setdefault(literal(p), []).append(p)  # a short literal would be met in every line
        for word, own in by_literal.items():
            # a pattern of its own literal is tried only where its other runs are met too, as a literal may be a common word
            others = tuple({r for r in plain_runs(own[0]) if r not in word}) if len(own) == 1 else ()
            self.automaton.add_word(word, (re.compile("|".join(own)), others))
        self.automaton.make_automaton()

    def may(self, text: str) -> bool:
        """Whether the plain runs of any pattern, or a pattern of the start, are in a text."""
        return self.start.match(text) is not None or any(all(r in text for r in others) for _, (_, others) in self.automaton.iter(text))

    def found(self, text: str) -> bool:
        if self.start.match(text) is not None:
            return True
        tried = set()
        for _, (p, others) in self.automaton.iter(text):
            if p not in tried:
                if all(r in text for r in others) and p.search(text) is not None:
                    return True
                tried.add(p)
        return False


_CUES = Phrases(CONSENT, LEGAL, PROMPT, CREDIT, TEASER)
_RESIDUES = Phrases(tuple(r"^\W*" + p[1:] if p[0] == "^" else p for p in RESIDUE))
_ANY = Phrases(CONSENT, LEGAL, PROMPT, CREDIT, TEASER, tuple(r"^\W*" + p[1:] if p[0] == "^" else p for p in RESIDUE))
_HOLE = re.compile(r"[{}%\[_<]|@@|\$[A-Za-z{]|XX| TK\)")
_TICKER = re.compile(r"^(?:[a-z]{2,6} [\d,]+\.\d+(?: ?[+-][\d.]+%)?\s*){1,8}$")
_PARTS = re.compile(r"\s*(?:\||·|/|»|>|›|•)\s*|\s{2,}")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_SENTENCE = re.compile(r"(?<=[.!?”\"])\s+")
_DECOR_HEAD = re.compile(r"^(?:[»*•>–—]+|--+|-)\s+")
_DECOR_TAIL = re.compile(r"\s*(?:\.\.\.|…|»|[!:;.])$")

WHOLE = 200  # characters; in a longer line, a share of the characters must stand in sentences with a phrase

TEXT, FURNITURE, MESSAGE, TEMPLATE, BLANK = "text", "furniture", "message", "template", "blank"


def plain(line: str) -> str:
    """The line without escapes, invisible characters and outer white space."""
    if "&" in line:
        line = html.unescape(line)
        line = _HIDDEN.sub("", line)
    return line.replace("\u00a0", " ").strip()


class Long:
    """A long line in lower case, its words, those of them that stand in a fixed list, and whether it may hold a placeholder: worked out once for all who ask."""

    __slots__ = ("hole", "listed", "low", "words")

    def __init__(self, line: str) -> None:
        self.low = line.lower()
        self.words = self.low.split()
        self.listed = _LISTED.intersection(self.words)
        self.hole = has_hole(line)


def bare(line: str, low: str | None = None) -> str:
    """The plain line in lower case, without a leading bullet or a trailing flourish; low: the line in lower case."""
    s = (line.lower() if low is None else low).replace("’", "'")
    for _ in range(2):
        head = _DECOR_HEAD.match(s)
        if head is None:
            break
        s = s[head.end() :]
    return (s[:-12] + _DECOR_TAIL.sub("", s[-12:])).strip()


def has_hole(line: str) -> bool:
    """Whether a line may hold a placeholder."""
    return ("{" in line or "%" in line or "[" in line or "_" in line or "<" in line or "@@" in line or "$" in line or "XX" in line or "TK)" in line) and _HOLE.search(line) is not None


def is_menu(s: str) -> bool:
    """Whether a bare line is a list of section names, or one of them."""
    first = _WORD.search(s)
    if first is None or first[0] not in NAV:
        return False
    words = _WORD.findall(s)
    known = sum(w in NAV for w in words)
    if known == len(words):
        return len(words) <= 3 or bool(_PARTS.search(s))
    return known >= 2 and known * 3 >= len(words) * 2 and len(_PARTS.split(s)) >= 2


def is_trail(s: str) -> bool:
    """Whether a bare line is a breadcrumb trail: section names, then a title."""
    for mark in (">", "»", "/", "›"):
        if mark not in s or f" {mark} " not in s:
            continue
        parts = [p.strip() for p in s.split(f" {mark} ")]
        if len(parts) >= 3 and all(is_menu(p) for p in parts[:-1]):
            return True
    return False


def residue_share(line: str, long: Long | None = None) -> float:
    """Share of a line's characters in sentences that are filler or an unfilled template."""
    if not (has_hole(line) if long is None else long.hole):
        words = line.lower().split() if long is None else long.words
        if len(FILLER.intersection(words if long is None else long.listed)) < min(3, len(words)):
            return 0.0
    total = bad = 0
    for s in _SENTENCE.split(line):
        total += len(s)
        own = s.split()
        holes = PLACEHOLDER.findall(s)
        if holes:
            bad += len(s) * (len(holes) * 11 >= len(own))
        elif len(own) >= 3:
            low = [w.strip(".,;:!?").lower() for w in own]
            bad += len(s) * (sum(w in FILLER for w in low) * 10 >= 7 * len(low))
    return bad / total if total else 0.0


SHORT = 160  # characters; what is found for a shorter line is remembered, as furniture returns on every page
_SEEN: dict[str, tuple[str, str]] = {}


def kind_of(line: str, long: Long | None = None) -> tuple[str, str]:
    """(kind, bare line) of one plain line seen alone."""
    if len(line) > SHORT:
        return _kind_of(line, long)
    found = _SEEN.get(line)
    if found is None:
        if len(_SEEN) > 100_000:
            _SEEN.clear()
        found = _SEEN[line] = _kind_of(line, None)
    return found


def _named(phrases: Phrases, s: str, share: float) -> bool:
    """Whether a phrase names a bare line: one anywhere in a short line, in sentences with a share of the characters of a longer one."""
    if not phrases.found(s):
        return False
    if len(s) <= WHOLE:
        return True
    parts = _SENTENCE.split(s)
    return sum(min(len(x), 2 * WHOLE) for x in parts if phrases.found(x)) >= share * sum(map(len, parts))


def _kind_of(line: str, long: Long | None) -> tuple[str, str]:
    if not line:
        return BLANK, ""
    s = bare(line, long and long.low)
    if not s or _STRAY.match(line):
        return FURNITURE, s
    if _ANY.may(s):
        if _named(_CUES, s, 0.5):
            return FURNITURE, s
        if _named(_RESIDUES, s, 0.8):
            return MESSAGE, s
    if _TICKER.match(s) or is_menu(s) or is_trail(s) or BYLINE.match(s):
        return FURNITURE, s
    if residue_share(line, long) >= 0.5:
        return TEMPLATE, s
    return TEXT, s


_ITEM = re.compile(r"^(?:\d{1,2}[.)]?|[-•*–])\s+")
_ENDED = re.compile(r"[.!?…:;,][\"'”’»)\]]*$")
_WHOLE = re.compile(r"[.!…][\"'”’»)\]]*$")
_BARS = re.compile(r"\s[|·/»>›•]\s")
LABEL = 90  # characters; a line of one label is no longer
RUN = 3  # lines; so many labels one below the other are a container of their own
SHARE = 0.2  # of the best score; a container apart from the essay with no more is dropped


def is_label(line: str) -> bool:
    """Whether a line looks like links, whatever its words: labels between bars, or a short capitalised one, with or without a bullet, that is no table row or sentence."""
    item = _ITEM.match(line)
    if item:
        line = line[item.end() :]
    if len(line) > 2 * LABEL or _ENDED.search(line) or "\t" in line:
        return False
    parts = _BARS.split(line)
    if len(parts) >= 3:
        return all(len(p.split()) <= 4 for p in parts) and sum(bool(_DIGIT.search(p)) for p in parts) * 2 < len(parts)
    words = [w for w in _WORD.findall(line) if len(w) > 3]
    return len(line) <= LABEL and bool(words) and sum(w[0].isupper() for w in words) * 3 >= 2 * len(words)


def sentences(line: str) -> int:
    """Sentences of a line; text without marks counts as one for each 260 characters."""
    item = _ITEM.match(line)
    return max(len(_SENTENCE.split(line[item.end() :] if item else line)), 1 + len(line) // 260)


def containers(lines: list[str], longs: list[Long | None]) -> list[list]:
    """[kind, bare, container] of each plain line; containers are "column", "aside" or "thread". longs: what is known of each long line.

    An aside runs from its header to the next blank line or, on pages without
    blank lines, to the next furniture or table row, the first line of several sentences or the
    second whole sentence that no headline precedes. A thread is a comment's header
    and the one line below it.
    """
    out: list[list] = []
    airy = lines.count("") * 6 >= len(lines)
    inside, left = "column", 0
    for line, long in zip(lines, longs, strict=True):
        kind, s = kind_of(line, long)
        if kind is BLANK:
            if inside == "aside":
                inside = "column"
            out.append([kind, s, "column"])
            continue
        if s and ("ago" in s or "vor " in s or "il y a" in s or "hace " in s) and _THREAD.search(s):
            inside, left = "thread", 1
            out.append([FURNITURE, s, "thread"])
            continue
        if s and len(s) < 40 and _SIDE.match(s):
            inside, left = "aside", 1
            out.append([FURNITURE, s, "aside"])
            continue
        if inside == "thread":
            if left and kind is not FURNITURE:
                left -= 1
                out.append([FURNITURE, s, "thread"])
                continue
            inside = "column"
        if inside == "aside":
            if kind is TEXT and "\t" not in line and sentences(line) <= (3 if airy else 1):
                left = 1 if airy or _ITEM.match(line) or not _WHOLE.search(line) else left - 1
                if left >= 0:
                    out.append([FURNITURE, s, "aside"])
                    continue
            if not airy or kind is not TEXT:
                inside = "column"
        out.append([kind, s, "column"])
    return out


PROSE = re.compile(r"[^\W\d_]+[^.!?]{25,}[.!?]")


def is_prose(line: str) -> bool:
    return len(line) >= 50 and line.count(" ") >= 7


def is_listed(line: str) -> bool:
    """Whether a line is an item or a table row as essays have them, not a link."""
    return ("\t" in line or _ITEM.match(line) is not None) and not is_label(line)


# what a line is, as bits of a number; its points stand above them
NAMED, APART, LIKE_LABEL, LIKE_PROSE, LIKE_ITEM, NAMED_RESIDUE = 1, 2, 4, 8, 16, 32
POINTS = 6


_TRAITS: dict[str, int] = {}


def bits_of(line: str, kind: str, inside: str) -> int:
    """A line's traits. It has 1 point, 1 for each comma and 1 for each 100 characters, three at most."""
    if kind is not TEXT:
        bits = (1 + line.count(",") + min(3, len(line) // 100)) << POINTS
        return bits | NAMED | (APART if inside != "column" else 0) | (NAMED_RESIDUE if kind is not FURNITURE else 0)
    if len(line) > SHORT:
        return _traits(line)
    found = _TRAITS.get(line)
    if found is None:
        if len(_TRAITS) > 100_000:
            _TRAITS.clear()
        found = _TRAITS[line] = _traits(line)
    return found


def _traits(line: str) -> int:
    bits = (1 + line.count(",") + min(3, len(line) // 100)) << POINTS
    if is_label(line):
        bits |= LIKE_LABEL
    else:
        bits |= LIKE_ITEM if "\t" in line or _ITEM.match(line) else 0
    return bits | (LIKE_PROSE if is_prose(line) else 0)


def read_lines(body: str | None) -> tuple[list[int], list[str], list[int], list[Long | None]]:
    """(numbers, plain lines, traits, what is known of each long line) of the lines that are not blank; none of a null or blank body."""
    if not body or not body.strip():
        return [], [], [], []
    if not body.isascii() and any(c in body for c in _INVISIBLE):
        body = _HIDDEN.sub("", body)
    lines = [plain(x) for x in body.split("\n")]
    longs = [Long(x) if len(x) > SHORT else None for x in lines]
    marks = containers(lines, longs)
    nos = [i for i, (kind, _, _) in enumerate(marks) if kind is not BLANK]
    return nos, [lines[i] for i in nos], [bits_of(lines[i], marks[i][0], marks[i][2]) for i in nos], [longs[i] for i in nos]


def tree_scores(bits: list[int], chars: list[int], often: set[int]) -> list[tuple[int, int, float]]:
    """(first line, end, score) of each container of a page, given its lines' traits and sizes.

    often: positions of lines that return on many pages of the site. Those, lines a phrase names and lines in sidebars
    and threads are links; runs of them are containers, as are runs of labels and the runs of text
    between. A container's score is the points of its lines less its link density,
    so that links are left with nothing and a run of labels with next to nothing.
    """
    n = len(bits)
    link = [bool(b & (NAMED | APART)) or i in often for i, b in enumerate(bits)]
    label = [not k and bool(b & LIKE_LABEL) for k, b in zip(link, bits, strict=True)]
    spans: list[list[int]] = []
    start, run = 0, 0
    for i in range(n):
        run = run + 1 if label[i] else 0
        if i > start and link[i] != link[i - 1]:
            spans.append([start, i])
            start = i
        elif run == RUN and start < i - RUN + 1:
            # the labels just read leave the container before them
            spans.append([start, i - RUN + 1])
            start = i - RUN + 1
        elif not link[i] and not label[i] and i - start >= RUN and all(label[start:i]):
            spans.append([start, i])
            start = i
    if n:
        spans.append([start, n])
    found: list[tuple[int, int, float]] = []
    for a, b in spans:
        size = sum(chars[a:b])
        linked = sum(chars[i] for i in range(a, b) if link[i] or label[i])
        found.append((a, b, sum(x >> POINTS for x in bits[a:b]) * (1 - linked / size if size else 0.0)))
    return found


def _apart(bits: list[int], a: int, b: int) -> int:
    """How many lines lie between two containers; one of a sidebar or thread counts as many."""
    return sum(RUN if bits[i] & APART else 1 for i in range(a, b))


def essay_lines(bits: list[int], chars: list[int], often: set[int]) -> list[bool]:
    """For each line of a page whether it belongs to the essay: to the best container or one of its siblings.

    Siblings have points left and hold a line of prose, an item or a table row, a share
    of the best score, or a place one line away from the essay; so do those between the
    first and the last of these. All others are dropped. The traits of a sidebar or a
    comment thread keep its lines out wherever they stand.
    """
    keep = [False] * len(bits)
    every = tree_scores(bits, chars, often)
    scored = [(a, b, s) for a, b, s in every if s > 0]
    if not scored:
        # a page of labels alone
        return [b & LIKE_LABEL > 0 and i not in often for i, b in enumerate(bits)]
    best = max(s for _, _, s in scored)
    good = [(a, b) for a, b, s in scored if s > SHARE * best or any(x & (LIKE_PROSE | LIKE_ITEM) for x in bits[a:b])]
    lo, hi = min(a for a, _ in good), max(b for _, b in good)
    for a, b, _ in scored:
        if a >= hi and _apart(bits, hi, a) <= 1:
            hi = b
    for a, b, _ in reversed(scored):
        if b <= lo and _apart(bits, b, lo) <= 1:
            lo = a
    for a, b, s in every:
        # labels within the essay are its subheads
        if a >= lo and b <= hi and (s > 0 or bits[a] & LIKE_LABEL and a not in often):
            keep[a:b] = [True] * (b - a)
    return keep


# --- fixed values: given names by which a person's name is recognised in a line, and month names ---

GIVEN = frozenset(
    """alexander andrew anna anthony barbara beatrice benjamin björn brian carlos caroline catherine charles chiara christine christopher
    claire daniel david deborah diana diego dorothy edward elena elizabeth emily emma eric ernest eva francesca frank frederick george
    gregory hannah harold hélène helen henry hugo ingrid irene isabel jack james jane jean jennifer joanna john josephine joseph juan
    julia karen karl katherine kenneth laura lawrence leon linda louis louise lucía lucy luis luke marco margaret maria marie mark martha
    martin mary matthew michael michelle miguel monica nancy naomi nathan nicholas nina olga oliver oscar otto pablo patricia patrick paul
    pedro peter philip quentin rachel ralph raymond rebecca richard robert roger ronald rosa ruth samuel sandra sarah sofia sophie stephen
    susan teresa theodore thomas timothy umberto victor victoria viktor vincent walter wendell william xavier yusuf yvonne zachary""".split()
)
_MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
# --- end of fixed values ---

_DATE = re.compile(rf"\d{{4}}[-/.]\d\d?[-/.]\d\d?|\d\d?[./]\d\d?[./]\d{{4}}|\d\d?\.? (?:de )?(?:{_MONTH})\.?,? (?:de )?\d{{4}}|\b(?:{_MONTH})\.? \d\d?,? \d{{4}}")
_MONTHS = frozenset(f"{a}{m}{b}" for m in "jan january feb february mar march apr april may jun june jul july aug august sep sept september oct october nov november dec december".split() for a in ("", "(") for b in ("", ".", ",", ".,"))
_LETTERS = re.compile(r"[\W\d_]+")
_DROP = bytes(c for c in range(128) if not chr(c).isalpha())
_COMMON = " .,-'’“”\"—–:;()?!…%$€£0123456789"
_YEAR = re.compile(r"\d{4,}")
_AROUND = 30, 10  # characters before and after four digits in a row; a date that holds them ends within these
_TITLES = frozenset("dr prof sir mr mrs ms chair".split())
_SUFFIXES = frozenset("jr sr ii iii iv phd".split())
_EDGE = "\"'“”‘’.,;:!?()[]|·—–-»*•"


# given names with the marks that stand beside them
_GIVEN_TYPED = frozenset(f"{a}{g}{b}" for g in GIVEN for a in ("", "(", "[", '"', "'", "“", "‘", "«", "—", "–", "*", "•") for b in ("", ",", ".", ";", ":", "!", "?", ")", "]", '"', "'", "”", "’", "»", "—", "|", ".”", ",”", ".)", ").", "),"))


def without_names(words: list[str]) -> list[str]:
    """Lower-case words without the persons' names: a given name with its title, initials, surname and suffix."""
    hits = [] if _GIVEN_TYPED.isdisjoint(words) else [i for i, w in enumerate(words) if w in _GIVEN_TYPED]
    if not hits:
        return words
    out: list[str] = []
    i, n = 0, len(words)
    for hit in hits:
        if hit < i:
            continue
        out += words[i:hit]
        if out and out[-1].strip(_EDGE) in _TITLES:
            out.pop()
        whole = words[hit]
        i = hit + 1
        while i < n and whole[-1] not in ",;:|·" and len(words[i].strip(".")) == 1 and words[i][0].isalpha():
            whole = words[i]
            i += 1
        if i < n and whole[-1] not in ",;:|·" and words[i][0].isalpha():
            i += 1
            if i < n and words[i].strip(_EDGE) in _SUFFIXES:
                i += 1
    return out + words[i:]


_LISTED = frozenset(FILLER) | _MONTHS | _GIVEN_TYPED
_KEYS: dict[str, str] = {}


def same_key(line: str, long: Long | None = None) -> str:
    """What is left of a plain line when case, spacing, punctuation, numbers, dates and persons' names do not count."""
    if len(line) <= SHORT:
        found = _KEYS.get(line)
        if found is None:
            if len(_KEYS) > 100_000:
                _KEYS.clear()
            found = _KEYS[line] = _same_key(line.lower())
        return found
    return _same_key(line.lower()) if long is None else _same_key(long.low, long.words, long.listed)


def _same_key(low: str, words: list[str] | None = None, listed: frozenset[str] | None = None) -> str:
    if words is None or listed is None:
        words = low.split()
        listed = _LISTED.intersection(words)
    if listed:
        if not _MONTHS.isdisjoint(listed) and any(_DIGIT.search(" ".join(words[max(0, i - 2) : i + 2])) for i, w in enumerate(words) if w in _MONTHS):
            words = without_dates(low).split()
            listed = _LISTED.intersection(words)
        if not _GIVEN_TYPED.isdisjoint(listed):
            words = without_names(words)
    return letters("".join(words))


def without_dates(low: str) -> str:
    """A line in lower case without its dates; every date holds four digits in a row, so only the places around such are searched."""
    places: list[list[int]] = []
    for year in _YEAR.finditer(low):
        start, end = max(0, year.start() - _AROUND[0]), year.end() + _AROUND[1]
        if places and start <= places[-1][1]:
            places[-1][1] = end
        else:
            places.append([start, end])
    out, at = [], 0
    for start, end in places:
        for date in _DATE.finditer(low, start, end):
            out.append(low[at : date.start()])
            at = date.end()
    return "".join(out) + low[at:]


def letters(low: str) -> str:
    """The letters of a text, and what counts as letters in words."""
    if low.isascii():
        return low.encode().translate(None, _DROP).decode()
    for c in _COMMON:
        low = low.replace(c, "")
    return low if low.isalpha() else _LETTERS.sub("", low)


_HEXISH = re.compile(r"\d(?:[a-z]|(?<=[a-z]\d))")
_HEX = re.compile(r"\b(?=[a-z]*\d)(?:[0-9a-f]{6,}|[0-9a-z]{8,})\b")
_SHAPES = bytes(97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else 32 for c in range(256))
_URL = re.compile(r"\b(?:https?://|www\.)\S+|\S+@\S+\.\w+")


def is_coded(low: str) -> bool:
    """Whether a line in lower case has a digit beside a letter from a to z."""
    if not low.isascii():
        return _HEXISH.search(low) is not None
    shapes = low.encode().translate(_SHAPES)
    return b"0a" in shapes or b"a0" in shapes


def masked(line: str, key: str, low: str | None = None) -> str:
    """A plain line with addresses, codes, numbers and dates masked; key is its sameness key, which is all of it where there are none; low: the line in lower case."""
    low = line.lower() if low is None else low
    linked = "@" in low or "www." in low or "://" in low
    if linked or is_coded(low):
        return _same_key(_HEX.sub("", _URL.sub("", low) if linked else low))
    return key


_MASKS: dict[str, str | None] = {}


def _whole_mask(line: str, key: str, long: Long | None) -> str | None:
    """The mask of a line that is one part; none where it has placeholders or filler."""
    if has_hole(line) if long is None else long.hole:
        return None
    if len(FILLER.intersection(line.lower().split() if long is None else long.listed)) >= 3:
        return None
    return masked(line, key, long and long.low)


def message_parts(line: str, bits: int, key: str, long: Long | None = None) -> list[tuple[str, int, bool]]:
    """(mask, characters, whether a rule names it) of the parts of a line that may be messages.

    A part is the line or, where it has placeholders or filler, each of its sentences, since templates
    come in any order of sentences; placeholders are masked, and a sentence of filler has one mask whatever its words.
    """
    if len(line) > SHORT:
        mask = _whole_mask(line, key, long)
    elif line in _MASKS:
        mask = _MASKS[line]
    else:
        if len(_MASKS) > 100_000:
            _MASKS.clear()
        mask = _MASKS[line] = _whole_mask(line, key, None)
    if mask is not None:
        return [(mask, len(line), bool(bits & NAMED_RESIDUE))]
    out = []
    for s in _SENTENCE.split(line):
        words = s.split()
        holes = len(PLACEHOLDER.findall(s))
        if holes:
            out.append(("{}" + same_key(PLACEHOLDER.sub(" ", s)), len(s), holes * 11 >= len(words)))
            continue
        low = [w.strip(".,;:!?").lower() for w in words]
        if sum(w in FILLER for w in low) * 10 >= 7 * len(low):
            out.append(("lorem", len(s), len(low) >= 3 or bool(bits & NAMED_RESIDUE)))
        else:
            out.append((masked(s, same_key(s)), len(s), bool(bits & NAMED_RESIDUE) and residue_share(line) < 0.5))
    return out
