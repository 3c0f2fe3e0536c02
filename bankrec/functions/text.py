"""Text keys: accents, normalisation, company keys, and the two rendered texts."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words left out of a company key.
STOP_WORDS = ("LDA", "SA", "DE", "DA", "DO", "E")

# Fixed value: the white space that text is stripped of, all of Unicode's.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
               "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(col: Column | str) -> Column:
    """Text without white space at its ends."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE_SPACE))


def _plain(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


def _decomposed() -> dict[str, str]:
    """Each code point that decomposition or the loss of marks changes. Marks become
    nothing, so their order never matters and a text folds one character at a time.
    Syllables of Hangul are left out; they are computed."""
    points = (chr(cp) for lo, hi in ((0x80, 0xD7FF), (0xE000, sys.maxunicode)) for cp in range(lo, hi + 1))
    return {c: _plain(c) for c in points
            if not _SYLLABLES[0] <= c <= _SYLLABLES[1]
            and (unicodedata.combining(c) or not unicodedata.is_normalized("NFKD", c))}


def _separating(char: str, plain: str) -> str:
    """For keys, white space separates words, but an accent, sign or ligature that
    decomposes to a blank or comma never does."""
    return " " if char.isspace() else plain.replace(" ", "").replace(",", "")


_SYLLABLES = ("가", "힣")
_MAP = _decomposed()
_KEY_MAP = {c: _separating(c, p) for c, p in _MAP.items()} | {c: " " for c in WHITE_SPACE if ord(c) > 0x7F}


def quoted(text: str) -> str:
    """A SQL string literal, taken as it is."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _syllable(c: str) -> str:
    """The letters of a Hangul syllable, by its place in the block."""
    def pick(first: int, n: int, at: str) -> str:
        return f"substring({quoted(''.join(chr(first + i) for i in range(n)))}, cast({at} as int), 1)"
    place = f"(ascii({c}) - {ord(_SYLLABLES[0])})"
    return (f"concat({pick(0x1100, 19, f'{place} div 588 + 1')}, {pick(0x1161, 21, f'({place} % 588) div 28 + 1')}, "
            f"if({place} % 28 = 0, '', {pick(0x11A8, 27, f'{place} % 28')}))")


def _char_class(chars: list[str]) -> str:
    """A pattern for these characters, neighbours joined to ranges."""
    runs: list[list[int]] = []
    for point in sorted(map(ord, chars)):
        if runs and runs[-1][1] == point - 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    return "[" + "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in runs) + "]"


class _Folding:
    """SQL that replaces characters by a table."""

    def __init__(self, table: dict[str, str]) -> None:
        one = {c: p for c, p in table.items() if len(p) == 1}
        many = {c: p for c, p in table.items() if len(p) > 1}
        # characters without a counterpart at the end are removed
        self.find = quoted("".join(one) + "".join(c for c, p in table.items() if not p))
        self.put = quoted("".join(one.values()))
        self.long = quoted(_char_class([*many, *map(chr, range(ord(_SYLLABLES[0]), ord(_SYLLABLES[1]) + 1))]))
        # one literal that Spark folds into a map, rather than an expression per entry;
        # between entries, characters for private use, which the table cannot hold
        entries = "\ue000".join(f"{c}\ue001{p}" for c, p in many.items())
        self.map = f"str_to_map({quoted(entries)}, '\ue000', '\ue001')"

    def sql(self, col: str) -> str:
        """Plain ASCII text, the common case, passes through untouched. The tables stand in
        the expression once, as the folded text is named."""
        letters = (f"transform(split(s, ''), c -> case when c < '\x80' then c "
                   f"when c between '{_SYLLABLES[0]}' and '{_SYLLABLES[1]}' then {_syllable('c')} "
                   f"else coalesce(try_element_at({self.map}, c), c) end)")
        folded = (f"transform(array(translate({col}, {self.find}, {self.put})), "
                  f"s -> if(s rlike {self.long}, array_join({letters}, ''), s))[0]")
        return f"if(octet_length({col}) > char_length({col}), {folded}, {col})"


_TEXT, _KEY = _Folding(_MAP), _Folding(_KEY_MAP)


def strip_accents(col: str) -> Column:
    """Compatibility decomposition without combining marks; ``col`` is a column name
    or a SQL expression."""
    return F.expr(_TEXT.sql(col))


def normalize(col: str) -> Column:
    """Accent-free upper case, letters A-Z and digits only."""
    return F.expr(f"regexp_replace(upper({_TEXT.sql(col)}), '[^A-Z0-9]', '')")


_APART = r"\s\x1c-\x1f,"     # what separates words


def company_key(col: str) -> Column:
    """Company name without legal-form words, for equality across spellings. A stop word may
    carry punctuation between its letters, as in "S.A."."""
    bare = f"regexp_replace(upper({_KEY.sql(col)}), {quoted(f'[^A-Z0-9{_APART}]+')}, '')"
    stop = ", ".join(map(quoted, STOP_WORDS))
    # of the remaining characters only separators stand between words
    return F.expr(f"array_join(filter(regexp_extract_all({bare}, '[A-Z0-9]+', 0), w -> w not in ({stop})), '')")


def key_of(name: str) -> Column:
    """Company key of one name."""
    return company_key(quoted(name))


# Fixed formats: the texts of a case and of a line.
def case_text(empresa: Column, descricao: Column, valor: Column) -> Column:
    """``empresa | descricao | valor EUR``; blank description when there is none."""
    return F.format_string("%s | %s | %s EUR", empresa, F.coalesce(descricao, F.lit("")),
                           valor.cast("decimal(18,2)").cast("string"))


def line_text(linha: Column, tipo: Column, empresa: Column, previsto: Column,
              imputacao: Column) -> Column:
    imputacao = F.when(F.coalesce(imputacao, F.lit("")) == "", "(vazia)").otherwise(imputacao)
    return F.format_string("linha %s (%s): empresa %s, previsto %s, imputação: %s",
                           linha, tipo, empresa, F.coalesce(previsto.cast("string"), F.lit("None")),
                           imputacao)
