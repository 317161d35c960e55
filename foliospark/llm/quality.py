"""Line-first cleaning: rules judge each line, failing lines go, and a text that loses too much is rejected.

Words are runs of anything but space and bytes 9-13; lines are what \\n separates; a line without a word is
layout and always stays.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_columns

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: A line with more than half as many symbols as words fails.
SYMBOLS_PER_2_WORDS = 1
#: A line of more words than this without any mark of a sentence fails: it is a list of words, whatever the language.
LONG_WORDS, SENTENCE = 20, r"[.,;:!?…。，、！？]"
#: A line with so many separators that are words of their own, or one that ends in one, is navigation if they make up a quarter of its words.
SEPARATORS, SEPARATOR_SHARE = 3, 4
SEPARATOR = r"[|>»·•/\\-]+"
#: A line of two or more names of menus and nothing else is navigation. Fixed values, of five languages.
MENU = (
    "home|homepage|about|about us|contact|contact us|login|log in|sign in|sign up|register|search|menu|help|faq|sitemap|privacy|privacy policy|terms|cookies|imprint|newsletter|next|previous|back to top|"
    "startseite|über uns|kontakt|anmelden|registrieren|suche|hilfe|datenschutz|impressum|agb|weiter|zurück|"
    "accueil|à propos|contactez-nous|connexion|inscription|rechercher|aide|mentions légales|confidentialité|suivant|précédent|"
    "inicio|sobre nosotros|contacto|iniciar sesión|registrarse|buscar|ayuda|aviso legal|privacidad|siguiente|anterior|"
    "início|sobre nós|contato|entrar|cadastre-se|ajuda|privacidade|próximo"
)
NAVIGATION = rf"^[\t |>»·•/\\-]*(?i:(?:{MENU})(?:[\t\r |>»·•/\\-]+|$)){{2,}}$"
#: Lines that begin so are boilerplate of web pages. Fixed values, of five languages.
BOILERPLATE = (
    r"^[\t ]*(?i:accept all cookies|this site uses cookies|we use cookies|all rights reserved|click here to|sign up for our|subscribe to our|share this (?:article|page|post)|skip to (?:main )?content|"
    r"javascript (?:is|must be) |alle cookies akzeptieren|diese (?:website|seite) verwendet cookies|wir verwenden cookies|alle rechte vorbehalten|hier klicken|newsletter abonnieren|zum inhalt springen|"
    r"accepter tous les cookies|ce site utilise des cookies|nous utilisons des cookies|tous droits réservés|cliquez ici|abonnez-vous à|aller au contenu|"
    r"aceptar todas las cookies|este sitio (?:web )?utiliza cookies|utilizamos cookies|todos los derechos reservados|haga clic aquí|suscríbase a|saltar al contenido|"
    r"aceitar todos os cookies|este site usa cookies|usamos cookies|todos os direitos reservados|clique aqui|assine nossa|ir para o conteúdo)"
)
#: A text that loses more than this percentage of its words' characters is rejected.
LOST_PERCENT = 30

_symbol, _sentence, _separator, _navigation, _boilerplate = map(re.compile, (SYMBOLS, SENTENCE, SEPARATOR, NAVIGATION, BOILERPLATE))
_not_in_word = b" \t\n\x0b\x0c\r"


def line_fails(line: str, words: list[bytes], symbols: int) -> bool:
    """Whether a rule for punctuation, navigation or boilerplate fails the line, which has words."""
    if 2 * symbols > SYMBOLS_PER_2_WORDS * len(words):
        return True
    if len(words) > LONG_WORDS and not _sentence.search(line):
        return True
    places = [i for i, w in enumerate(words, 1) if len(w) < 4 and _separator.fullmatch(w.decode())]
    if places and (len(places) >= SEPARATORS or places[-1] == len(words)) and SEPARATOR_SHARE * len(places) >= len(words):
        return True
    return _navigation.match(line) is not None or _boilerplate.match(line) is not None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    found, covered, end = Counter(windows), 0, 0
    if len(found) == len(windows):
        return 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def judge(text: str | None) -> dict:
    """All figures of one text, the verdicts and the cleaned text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen: set[str] = set()
    kept, duplicates, lost, symbols = [], 0, 0, 0
    for line in text.split("\n"):
        own = line.encode().split()
        if own:
            duplicates += line in seen
            seen.add(line)
            n = len(_symbol.findall(line))
            symbols += n
            if line_fails(line, own, n):
                lost += sum(len(w.decode()) for w in own)
                continue
        kept.append(line)
    chars = len(raw.translate(None, _not_in_word).decode())
    repeats = repeated_words(words)
    base_failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": duplicates, "n_repeat_words": repeats,
        "base_failed": base_failed, "lost_chars": lost, "kept": not base_failed and 100 * lost <= LOST_PERCENT * chars, "cleaned": "\n".join(kept),
    }


FIELDS = {
    "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(),
    "base_failed": T.BooleanType(), "lost_chars": T.LongType(), "kept": T.BooleanType(), "cleaned": T.StringType(),
}


def judge_texts(df: DataFrame, text: str = "text", keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """Each row with the figures, ``base_failed``, ``lost_chars``, ``kept`` and (with_text) the ``cleaned`` text.

    A null text is one without words: it fails. Rows are independent, so repeated rows get equal verdicts; an
    empty table gives an empty one; other columns pass unless they have one of the new names.
    """
    names = [n for n in FIELDS if with_text or n != "cleaned"]

    def run(texts: list) -> dict[str, list]:
        all_of = [judge(t) for t in texts]
        return {n: [x[n] for x in all_of] for n in names}

    return map_columns(df, [text], run, T.StructType([T.StructField(n, FIELDS[n]) for n in names]), keep)


#: The figures and verdicts of op7 in DuckDB's SQL over ``documents``.
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT row_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)),
windows AS (SELECT row_id, pos, [word, lead(word) OVER w, lead(word, 2) OVER w] AS win, lead(word, 2) OVER w IS NOT NULL AS whole FROM words WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
twice AS (SELECT row_id, pos FROM (SELECT row_id, pos, count(*) OVER (PARTITION BY row_id, win) AS n FROM windows WHERE whole) WHERE n > 1),
repeats AS (SELECT row_id, count(DISTINCT p) AS n FROM (SELECT row_id, unnest([pos, pos + 1, pos + 2]) AS p FROM twice) GROUP BY row_id),
lines AS (SELECT row_id, line, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(line, '{SYMBOLS}')) AS s,
    len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS c,
    len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: strlen(x) < 4 AND regexp_full_match(x, '{SEPARATOR}'))) AS seps,
    coalesce(regexp_full_match(regexp_extract_all(line, '[^\x20\x09-\x0D]+')[-1], '{SEPARATOR}') AND strlen(regexp_extract_all(line, '[^\x20\x09-\x0D]+')[-1]) < 4, false) AS open_end
  FROM (SELECT row_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT row_id, string_split(text, chr(10)) AS l FROM docs))),
judged AS (SELECT *, 2 * s > {SYMBOLS_PER_2_WORDS} * n OR (n > {LONG_WORDS} AND NOT regexp_matches(line, '{SENTENCE}'))
    OR ((seps >= {SEPARATORS} OR open_end) AND {SEPARATOR_SHARE} * seps >= n) OR regexp_matches(line, '{NAVIGATION}') OR regexp_matches(line, '{BOILERPLATE}') AS fails,
    row_number() OVER (PARTITION BY row_id, line ORDER BY pos) > 1 AS again FROM lines WHERE n > 0),
by_doc AS (SELECT row_id, sum(n) AS n_words, sum(c) AS word_chars, sum(s) AS n_symbols, sum(CASE WHEN again THEN 1 ELSE 0 END) AS dups,
    sum(CASE WHEN fails THEN c ELSE 0 END) AS lost FROM judged GROUP BY row_id),
figures AS (SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(coalesce(n_symbols, 0) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
  FROM docs LEFT JOIN by_doc USING (row_id) LEFT JOIN repeats r USING (row_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT *, NOT base_failed AND 100 * lost_chars <= {LOST_PERCENT} * word_chars AS kept FROM based
"""
