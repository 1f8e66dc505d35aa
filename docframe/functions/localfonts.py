"""Local fonts for font names: CSS family, weight and style, as columns and for one name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of names and CSS families, the first that a name (without hyphens and spaces, in any case) holds decides.
FAMILIES = (
    ("Courier", "'Courier New',Courier,monospace"), ("Helvetica", "Helvetica,Arial,sans-serif"), ("Times", "'Times New Roman',serif"), ("Symbol", "Symbol"), ("ArialBlack", "'Arial Black',Arial,sans-serif"),
    ("Arial", "Arial,sans-serif"), ("Bahnschrift", "Bahnschrift,sans-serif"), ("Calibri", "Calibri,sans-serif"), ("Cambria", "Cambria,serif"), ("Candara", "Candara,sans-serif"),
    ("ComicSans", "'Comic Sans MS','Comic Sans',cursive"), ("Consolas", "Consolas,monospace"), ("Constantia", "Constantia,serif"), ("Corbel", "Corbel,sans-serif"), ("Ebrima", "Ebrima,sans-serif"),
    ("Franklin", "'Franklin Gothic',sans-serif"), ("Gabriola", "Gabriola,cursive"), ("Gadugi", "Gadugi,sans-serif"), ("Georgia", "Georgia,serif"), ("Impact", "Impact,fantasy"), ("InkFree", "'Ink Free',cursive"),
    ("LucidaConsole", "'Lucida Console',monospace"), ("LucidaSans", "'Lucida Sans Unicode','Lucida Sans',sans-serif"), ("MalgunGothic", "'Malgun Gothic',sans-serif"), ("Marlett", "Marlett"),
    ("ftHimalaya", "'Microsoft Himalaya',sans-serif"), ("ftJhengHei", "'Microsoft JhengHei',sans-serif"), ("ftNewTaiLue", "'Microsoft New Tai Lue',sans-serif"), ("ftPhagsPa", "'Microsoft PhagsPa',sans-serif"),
    ("ftSansSerif", "'Microsoft Sans Serif',sans-serif"), ("ftTaiLe", "'Microsoft Tai Le',sans-serif"), ("ftYaHei", "'Microsoft YaHei',sans-serif"), ("ftYiBaiti", "'Microsoft Yi Baiti',sans-serif"),
    ("MingLiU", "'MingLiU-ExtB',serif"), ("MongolianBaiti", "'Mongolian Baiti',sans-serif"), ("MSGothic", "'MS Gothic',sans-serif"), ("MSPGothic", "'MS Gothic',sans-serif"), ("MVBoli", "'MV Boli',cursive"),
    ("Myanmar", "'Myanmar Text','Myanmar Unicode',sans-serif"), ("Nirmala", "'Nirmala UI',sans-serif"), ("Palatino", "'Palatino Linotype',Palatino,serif"), ("SegoePrint", "'Segoe Print',cursive"),
    ("SegoeScript", "'Segoe Script',cursive"), ("Segoe", "'Segoe UI',sans-serif"), ("SimSun", "SimSun,serif"), ("Sitka", "Sitka,serif"), ("Sylfaen", "Sylfaen,serif"), ("Tahoma", "Tahoma,sans-serif"),
    ("Trebuchet", "'Trebuchet MS',sans-serif"), ("Verdana", "Verdana,sans-serif"), ("Webdings", "Webdings"), ("Wingdings", "Wingdings"), ("YuGothic", "'Yu Gothic',sans-serif"), ("sans", "sans-serif"), ("roman", "serif"),
    ("serif", "serif"), ("book", "serif"), ("source", "monospace"), ("code", "monospace"), ("consol", "monospace"), ("mono", "monospace"), ("mincho", "serif"), ("ming", "serif"), ("song", "serif"),
)
#: Weights and styles in the part of a name from its first comma or hyphen on, then the short forms of short parts.
WEIGHTS = (
    ("demibold", 600), ("semibold", 600), ("extrabold", 800), ("ultrabold", 800), ("xtbold", 800), ("utbold", 800), ("ultralight", 200), ("extralight", 200), ("utlight", 200), ("xtlight", 200), ("normal", 400),
    ("regular", 400), ("roman", 400), ("medium", 500), ("thin", 100), ("hairline", 100), ("black", 900), ("light", 300), ("bold", 700),
)
SHORT_WEIGHTS = (("th", 100), ("lt", 300), ("md", 500), ("dm", 600), ("sm", 600), ("bd", 700), ("bl", 900))
STYLES, SHORT_STYLES = (("oblique", "oblique"), ("italic", "italic")), (("ob", "oblique"), ("it", "italic"))
#: Characters of the part, its separator included, up to which the short forms count.
SHORT_WEIGHT, SHORT_STYLE = 5, 20
DEFAULT = "sans-serif"


def _first(text: Column, rules: tuple) -> Column:
    """The value of the first rule whose key the text holds; null without any."""
    out = F.lit(None)
    for key, value in reversed(rules):
        out = F.when(F.instr(text, key.lower()) > 0, F.lit(value)).otherwise(out)
    return out


def _part(name: Column) -> tuple[Column, Column]:
    """The lower-cased part of a name that tells weight and style (the whole name without a separator), and whether there is one."""
    low = F.lower(name)
    own = F.regexp_extract(low, "(?s)[,-].*", 0)
    return F.when(own == "", low).otherwise(own), (own != "") & ~low.startswith(",") & ~low.startswith("-")


def family(name: Column) -> Column:
    """CSS family of a font name; null and unknown names are sans-serif."""
    return F.coalesce(_first(F.lower(F.regexp_replace(name, "[- ]", "")), FAMILIES), F.lit(DEFAULT))


def _either(name: Column, rules: tuple, short: tuple, most: int) -> Column:
    part, is_part = _part(name)
    return F.coalesce(_first(part, rules), F.when(is_part & (F.length(part) <= most), _first(part, short)))


def weight(name: Column) -> Column:
    """CSS weight (100 to 900), null where the name tells none."""
    return _either(name, WEIGHTS, SHORT_WEIGHTS, SHORT_WEIGHT)


def style(name: Column) -> Column:
    """italic or oblique, null where the name tells neither."""
    return _either(name, STYLES, SHORT_STYLES, SHORT_STYLE)


def resolve(name: str) -> tuple[str, int | None, str | None]:
    """(family, weight, style) of one name."""
    held = lambda text, rules: next((v for k, v in rules if k.lower() in text), None)
    low = name.lower()
    at = min((i for i in (low.find(","), low.find("-")) if i >= 0), default=-1)
    part = low[max(at, 0) :]
    short = lambda rules, most: held(part, rules) if at > 0 and len(part) <= most else None
    return (
        held(low.replace("-", "").replace(" ", ""), FAMILIES) or DEFAULT,
        held(part, WEIGHTS) or short(SHORT_WEIGHTS, SHORT_WEIGHT),
        held(part, STYLES) or short(SHORT_STYLES, SHORT_STYLE),
    )
