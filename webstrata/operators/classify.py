"""Resource classes from URL suffixes and media types, payload kinds from first bytes, routing and selection policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions.text import extension_of, mime_of
from webstrata.sources.bodies import is_text

#: Extensions by class.
TEXT = ".asp .aspx .cfm .cgi .css .dat .dhtm .htm .html .inc .js .json .jsp .phtm .php .shtm .shtml .text .txt .xhtm .xhtml .xml".split()
IMAGE = ".avif .bmp .gif .heic .heif .ico .jfif .jpeg .jpg .jxl .png .svg .tif .tiff .webp".split()
VIDEO = ".3gp .asf .avi .f4v .flv .m2ts .m4v .mkv .mov .mp4 .mpe .mpeg .mpg .mts .ogm .ogv .qt .rm .rmvb .swf .ts .vob .webm .wmv".split()
AUDIO = ".aac .aiff .flac .m4a .mid .mp3 .oga .ogg .wav .wma".split()
DESCRIPTOR = ".asx .m3u .m3u8 .mpd .pls .ram .smil .smi .vtt .srt .wax .wvx .wmx .wpl".split()
BINARY = ".7z .ace .bin .bz2 .cab .class .dmg .doc .docx .eot .exe .gz .iso .jar .otf .pdf .ppt .pptx .rar .tar .tgz .torrent .ttf .woff .woff2 .xls .xlsx .zip".split()
ARCHIVE = ".7z .ace .cab .gz .rar .tar .tgz .zip".split()
#: Suffixes that are never text, whatever the media type says.
NEVER_TEXT_IMAGE = ".jpeg .jpg .png .bmp .gif .tiff .psd .dib .webp .sr .ras .jfif .xxx".split()
NEVER_TEXT_MEDIA = (
    ".webm .mpeg .mpg .wmv .mjpg .mjpeg .rv .avi .mov .3gp .rm .swf .flv .mkv .vob .ogv .ogg .drc .gifv .mng .mts .m2ts .ts .qt .yuv .rmvb .viv .asf .amv .m4p .m4v .mp2 "
    ".mpe .mpv .svi .3g2 .mxf .roq .nsv .f4v .f4p .f4a .f4b .asx .avchd .m2v .wma .wm .wax .wvx .wmx .wpl .dvr-ms .wmd .m1v .mpa .m3u .ivf .m4a .mp4 .mp4v .3gp2 .3gpp"
).split()
NEVER_TEXT_AUDIO = ".ogg .mp2 .mpa .m4a .wma .f4a .f4b".split()
#: Media types.
DESCRIPTOR_TYPES = ["application/dash+xml", "application/vnd.apple.mpegurl", "application/x-mpegurl", "application/smil+xml", "audio/mpegurl", "audio/x-mpegurl", "text/vtt"]
TEXT_TYPES = ["application/ecmascript", "application/javascript", "application/json", "application/ld+json", "application/rss+xml", "application/atom+xml", "application/xhtml+xml", "application/xml"]
UNKNOWN_TYPES = ["", "application/octet-stream", "application/binary", "binary/octet-stream"]


def class_of_type(mime: Column) -> Column:
    """Class of a media type, null if it tells nothing."""
    starts = lambda *xs: F.rlike(mime, F.lit("^(" + "|".join(xs) + ")"))
    return (
        F.when(mime.isin(UNKNOWN_TYPES), F.lit(None).cast("string"))
        .when(mime.isin(DESCRIPTOR_TYPES), "media_descriptor")
        .when(starts("image/"), "image")
        .when(starts("video/") | F.contains(mime, F.lit("shockwave-flash")), "video")
        .when(starts("audio/"), "audio")
        .when(starts("font/", "application/font", r"application/vnd\.ms-font") | F.rlike(mime, F.lit("pdf|msword|officedocument|zip|rar|gzip|7z|octet-stream")), "other_binary")
        .when(starts("text/") | mime.isin(TEXT_TYPES) | F.rlike(mime, F.lit(r"\+(json|xml)$")), "text")
    )


def class_of_extension(ext: Column) -> Column:
    groups = ((DESCRIPTOR, "media_descriptor"), (IMAGE, "image"), (VIDEO, "video"), (AUDIO, "audio"), (BINARY, "other_binary"), (TEXT, "text"))
    out = F.lit(None).cast("string")
    for members, name in reversed(groups):
        out = F.when(ext.isin(members), name).otherwise(out)
    return out


def classify(url: Column, mimetype: Column) -> Column:
    """struct(class, reason, confident) of an indexed resource.

    A suffix that is never text decides; else agreement of suffix and type is sure, a type alone too, a suffix alone is
    not; a conflict is unknown.
    """
    ext, mime = extension_of(url), mime_of(mimetype)
    by_ext, by_type = class_of_extension(ext), class_of_type(mime)
    never = (
        F.when(ext.isin(DESCRIPTOR), "media_descriptor").when(ext == ".xxx", "other_binary").when(ext.isin(NEVER_TEXT_IMAGE), "image").when(ext.isin(NEVER_TEXT_AUDIO), "audio").otherwise("video")
    )
    made = lambda kind, reason, sure: F.struct(kind.alias("class"), reason.alias("reason"), F.lit(sure).alias("confident"))
    return (
        F.when(ext.isin(NEVER_TEXT_IMAGE + NEVER_TEXT_MEDIA), made(never, F.concat(F.lit("suffix_policy:"), ext), True))
        .when(by_ext == by_type, made(by_type, F.concat(F.lit("agree:"), mime, ext), True))
        .when(by_ext.isNotNull() & by_type.isNotNull(), made(F.lit("unknown"), F.concat(F.lit("conflict:"), mime, ext), False))
        .when(by_type.isNotNull(), made(by_type, F.concat(F.lit("mime:"), mime), True))
        .when(by_ext.isNotNull(), made(by_ext, F.concat(F.lit("extension:"), ext), False))
        .otherwise(made(F.lit("unknown"), F.lit("no_evidence"), False))
    )


#: Kinds of payloads by their first bytes in hex; forms of RIFF files; brands of images among ISO media.
SIGNATURES = (
    ("image", ("89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961")),
    ("other_binary", ("255044462D", "504B0304", "1F8B08")),
    ("audio", ("664C6143", "4F67675300", "49443303", "49443304")),
    ("video", ("1A45DFA3", "464C5601")),
)
RIFF_FORMS = {"57454250": "image", "41564920": "video", "57415645": "audio"}
IMAGE_BRANDS = ("avif", "avis", "heic", "heix", "mif1")


def payload_kind(content: Column, mimetype: Column | None = None, url: Column | None = None) -> Column:
    """Kind of a payload: by the suffix that is never text, by its first bytes, else text if it can be read as such.

    The media type only tells drawings and descriptors from other text, and that of images, sounds and films from text.
    """
    mimetype = F.lit("") if mimetype is None else F.coalesce(mimetype, F.lit(""))
    head = F.hex(F.substring(content, 1, 16))
    form = F.try_element_at(F.create_map(*[F.lit(x) for pair in RIFF_FORMS.items() for x in pair]), F.substring(head, 17, 8))
    brand = F.lower(F.decode(F.substring(content, 9, 4), "ISO-8859-1"))
    drawn = (mime_of(mimetype) == "image/svg+xml") & F.contains(F.lower(F.decode(F.substring(content, 1, 4096), "ISO-8859-1")), F.lit("<svg"))
    rules = [F.when(F.rlike(head, F.lit("^(" + "|".join(marks) + ")")), kind) for kind, marks in SIGNATURES]
    rules.insert(1, F.when(F.startswith(head, F.lit("52494646")), form))
    rules.insert(2, F.when((F.substring(head, 9, 8) == "66747970") & (F.length(head) >= 24), F.when(brand.isin(*IMAGE_BRANDS), "image").otherwise("video")))
    rules += [F.when(drawn, "image"), F.when(~is_text(content, mimetype), "other_binary")]
    if url is not None:
        own = classify(url, mimetype)
        rules.insert(0, F.when(F.startswith(own["reason"], F.lit("suffix_policy:")), own["class"]))
        rules.append(F.when(own["class"] == "media_descriptor", "media_descriptor"))
    return F.coalesce(*rules, F.lit("text"))


def text_candidate(url: Column, mimetype: Column) -> Column:
    """Whether a resource may be text: its type before its suffix, true if neither tells."""
    mime, ext = mime_of(mimetype), extension_of(url)
    return F.when(class_of_type(mime) == "text", True).when(class_of_type(mime).isNotNull(), False).when(class_of_extension(ext).isin("image", "video", "audio", "other_binary"), False).otherwise(True)


def routing(url: Column, mimetype: Column, matches: Column) -> Column:
    """What becomes of an indexed capture: queue, deferred, filtered or skipped."""
    kind = classify(url, mimetype)["class"]
    robots = F.rlike(url, F.lit(r"(?i)/robots\.txt(?:[?#]|$)"))
    elsewhere = dict.fromkeys(("image", "video", "audio", "media_descriptor"), "deferred_to_media") | {"other_binary": "unsupported"}
    by_class = F.try_element_at(F.create_map(*[F.lit(x) for pair in elsewhere.items() for x in pair]), kind)  # the class is long code: named once
    return F.coalesce(F.when(robots, "skipped_robots"), by_class, F.when(~matches, "keyword_filter"), F.lit("queue"))
