"""Identifier, caption and file-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes in Python.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The caption of an empty caption, and of an object known only by name.
EMPTY_CAPTION = "3d object"
NAMED_CAPTION = "a 3D character named "

# Models whose text encoder wants lower-cased captions.
LOWERCASE_MODELS = ("paa", "pas")

# Fixed value: characters of a prompt that go into an output name.
NAME_LENGTH = 20


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def plain_path(url: Column) -> Column:
    """A path as ``_metadata`` reports it (URL-encoded) in plain text."""
    return F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))


def norm_uid(uid: Column) -> Column:
    """Last path part, up to its first dot."""
    return F.substring_index(F.substring_index(uid, "/", -1), ".", 1)


def oid_of(path: Column) -> Column:
    """Second path part, up to its first dot; NULL when there is no second part."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(F.split_part(path, F.lit("/"), F.lit(2)), ".", 1))


def clean_caption(caption: Column) -> Column:
    stripped = strip(caption)
    return F.when(stripped == "", F.lit(EMPTY_CAPTION)).otherwise(stripped)


def model_caption(caption: Column, model: str) -> Column:
    return strip(F.lower(caption)) if model in LOWERCASE_MODELS else caption


def spaced(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def name_caption(name: Column) -> Column:
    return F.concat(F.lit(NAMED_CAPTION), spaced(name))


def arg_prompt(argument: Column) -> Column:
    return spaced(argument)


def padded(number: Column, width: int) -> Column:
    """Zero-padded integer that, unlike lpad, never loses digits."""
    return F.format_string(f"%0{width}d", number)


def prompt_output_name(image_name: Column, prompt: Column, iteration: Column) -> Column:
    """``[image]_[prompt start...]_000123``; the dots follow any non-empty prompt."""
    start = F.substring(prompt, 1, NAME_LENGTH)
    shown = F.when(start != "", F.concat(start, F.lit("..."))).otherwise(start)
    return F.concat(F.lit("["), image_name, F.lit("]_["), shown, F.lit("]_"), padded(iteration, 6))


def id_output_name(image_index: Column, prompt_index: Column, iteration: Column) -> Column:
    return F.concat_ws("_", padded(image_index, 3), padded(prompt_index, 3), padded(iteration, 6))


def output_iter(path: Column) -> Column:
    """Iteration number of a rendered strip; NULL for any other file."""
    digits = F.regexp_extract(path, r"_(\d+)_gs\.png$", 1)
    return F.when(digits != "", digits).try_cast("int")
