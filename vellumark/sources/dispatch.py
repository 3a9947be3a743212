"""Which reader a document goes to, by name and first bytes: the first that claims it wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RASTER = ".jpg .jpeg .png .gif .bmp .tiff .tif .webp .heic .heif"
_MORE_RASTER = ".ico .cur .icns .jp2 .j2k .jpf .jpx .jpm .mj2 .avif .jfif .pjpeg .pjp .apng .dds .dib .eps .pcx .pbm .pgm .ppm .pnm .tga .xbm .xpm"
_LITERAL = (
    ".py .pyi .js .mjs .cjs .ts .tsx .jsx .java .kt .kts .scala .go .rs .c .h .cc .cpp .cxx .hpp .cs .swift .m .mm .rb .php .pl .pm .lua .r .jl .dart .sh .bash .zsh .fish .ps1 .bat .cmd "
    ".sql .json .jsonl .ndjson .yaml .yml .toml .ini .cfg .conf .properties .env .xml .xsd .xsl .css .scss .less .vue .svelte .gradle .groovy .makefile .cmake .dockerfile .proto .graphql .tf .log .diff .patch"
)
_PROSE = ".txt .text .md .markdown .mdx .rst .adoc .asciidoc .org .tex .textile .wiki .rmd .qmd"

#: Readers in order of priority, with the endings they claim.
READERS: dict[str, tuple[str, ...]] = {
    "html": tuple(".html .htm .xhtml .shtml".split()),
    "mhtml": (".mhtml", ".mht"),
    "docx": tuple(".docx .docm .doc .dotx .dotm".split()),
    "pdf": (".pdf",),
    "xlsx": tuple(".xlsx .xlsm .xltx .xltm".split()),
    "xls": (".xls", ".xlt"),
    "csv": (".csv", ".tsv", ".tab"),
    "fb2": (".fb2", ".fb2.zip"),
    "zip": (".zip",),
    "xmind": (".xmind",),
    "pptx": tuple(".pptx .pptm .ppsx .ppsm .potx .potm".split()),
    "ppt": (".ppt", ".dps"),
    "wps": (".wps", ".et"),
    "rtf": (".rtf",),
    "odf": tuple(".odt .ods .odp .ott .ots .otp .fodt .fods .fodp".split()),
    "epub": (".epub",),
    "eml": (".eml",),
    "msg": (".msg",),
    "mobi": tuple(".mobi .azw .azw1 .azw3 .azw4 .prc".split()),
    "tar": tuple(".tar .tar.gz .tgz .tar.bz2 .tbz2 .tar.xz .txz".split()),
    "7z": (".7z",),
    "svg": (".svg", ".svgz"),
    "ipynb": (".ipynb",),
    "subtitle": tuple(".srt .vtt .ass .ssa .sub".split()),
    "mbox": (".mbox",),
    "ics": (".ics", ".ifb"),
    "vcf": (".vcf",),
    "image": tuple(_RASTER.split()),
    "raster": tuple(_MORE_RASTER.split()),
    "literal": tuple(_LITERAL.split()),
    "text": tuple(_PROSE.split()),
}
#: Endings that are never tried as text.
REFUSED = tuple(".mp4 .mov .avi .mkv .mp3 .wav .flac .ogg .rar .exe .dll .so .bin .iso .dmg .pages .numbers .key .class .jar .pyc .woff .woff2 .ttf .otf".split())


def reader_of(name: str) -> str | None:
    """The reader that claims a name; text for unknown endings, None for refused ones."""
    low = name.lower()
    for reader, endings in READERS.items():
        if low.endswith(endings):
            return reader
    return None if low.endswith(REFUSED) else "text"


def reader_column(name: Column) -> Column:
    """reader_of as an expression."""
    low = F.lower(name)
    case = F
    for reader, endings in READERS.items():
        case = case.when(low.rlike("(" + "|".join(e.replace(".", "\\.") for e in endings) + ")$"), reader)
    return case.when(low.rlike("(" + "|".join(e.replace(".", "\\.") for e in REFUSED) + ")$"), F.lit(None)).otherwise("text")


def supported_extensions() -> list[str]:
    return sorted(e for endings in READERS.values() for e in endings)
