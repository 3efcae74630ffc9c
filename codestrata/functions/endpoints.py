"""Endpoints and message consumers out of annotation texts, as arrays of structs, in columns only.

One reading of annotation arguments serves all extractors: `arguments` gives what stands between an annotation's
brackets, `attribute` the value of a named argument, `positional` that of an unnamed one, and `items` the values of a
list or a single one without quotes and `.class`. An extractor takes the annotation's text and, where it needs them, the
class's annotations, all annotations of the method, the return type and the parameter list; nulls count as ''. It gives
an empty array where it has nothing to say. `endpoints` applies all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.functions.names import merge_paths

# fixed values: annotations and what they stand for
SPRING_MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "REQUEST"}
JAXRS_VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]
SCHEMA = "array<struct<type:string,path:string,produces:string,consumes:string>>"

# chunks are taken whole (++), so that the matcher's depth grows with the number of strings, not of characters
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"' + r"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_VALUE = rf"\{{(?:[^}}\"']++|{_STRING})*+\}}|{_STRING}|[\w.$]+"


def arguments(text: Column, name: str) -> Column:
    """What stands between the brackets of `@name(...)`; '' without brackets."""
    return F.regexp_extract(text, rf"@\s*{name}\s*\(((?:[^()\"']++|{_STRING}|\((?:[^()\"']++|{_STRING})*+\))*+)\)", 1)


def attribute(given: Column, name: str) -> Column:
    """The value of a named argument as it is written; '' if it isn't given."""
    found = F.regexp_extract_all(given, F.lit(rf"\b{name}\s*=\s*({_VALUE})|{_STRING}"), 1)
    return F.coalesce(F.get(F.filter(found, lambda v: v != ""), F.lit(0)), F.lit(""))


def positional(given: Column) -> Column:
    """The value of an unnamed first argument as it is written; '' if there is none."""
    return F.regexp_extract(given, rf"^\s*({_VALUE})\s*(?:,|$)", 1)


def items(value: Column) -> Column:
    """The values of a list, or of a single one: texts without quotes, classes without `.class`; empty ones are dropped."""
    plain = F.transform(F.regexp_extract_all(value, F.lit(rf"{_STRING}|[\w.$]+"), 0), lambda v: F.regexp_replace(F.trim(F.regexp_replace(v, "^[\"']|[\"']$", "")), r"\.class$", ""))
    return F.filter(plain, lambda v: v != "")


def _first_string(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, _STRING, 0), "^[\"']|[\"']$", "")


def _found(condition: Column, kind: Column, path: Column) -> Column:
    one = F.struct(kind.alias("type"), path.alias("path"), F.lit("").alias("produces"), F.lit("").alias("consumes"))
    return F.when(condition, F.array(one)).otherwise(F.array()).cast(SCHEMA)


def _consumers(condition: Column, kind: str, names: Column) -> Column:
    each = F.transform(names, lambda n: F.struct(F.lit(kind).alias("type"), F.lit("").alias("path"), F.lit("").alias("produces"), n.alias("consumes")))
    return F.when(condition, each).otherwise(F.array()).cast(SCHEMA)


def _has(text: Column, name: str) -> Column:
    return F.contains(F.coalesce(text, F.lit("")), F.lit("@" + name))


def _is(text: Column, name: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(rf"@\s*{name}\b")


def spring_mapping(text: Column, class_text: Column, method_text: Column, return_type: Column) -> Column:
    """A web mapping of a controller whose results are bodies; the annotation's first string is its path."""
    named = F.coalesce(*[F.when(_has(text, mark), F.lit(verb)) for mark, verb in SPRING_MAPPINGS.items()])
    asked = F.regexp_extract(attribute(arguments(text, "RequestMapping"), "method"), r"RequestMethod\.(\w+)", 1)
    verb = F.when((named == "REQUEST") & (asked != ""), asked).otherwise(named)
    reactive = F.when(F.coalesce(return_type, F.lit("")).rlike("Mono|Flux"), F.lit("_REACTIVE")).otherwise("")
    served = _has(class_text, "RestController") | _has(method_text, "ResponseBody")
    path = merge_paths(_first_string(arguments(class_text, "RequestMapping")), _first_string(text))
    return _found(verb.isNotNull() & served & ~_has(text, "ExceptionHandler"), F.concat(verb, reactive), path)


def spring_exception_handler(text: Column, class_text: Column) -> Column:
    """The exceptions that a handler takes: one by its name, a list in square brackets."""
    given = arguments(text, "ExceptionHandler")
    value = F.coalesce(F.nullif(attribute(given, "value"), F.lit("")), positional(given))
    names = F.array_join(items(value), ", ")
    path = F.when(F.startswith(value, F.lit("{")), F.concat(F.lit("["), names, F.lit("]"))).otherwise(names)
    kind = F.when(_has(class_text, "RestControllerAdvice"), "REST_EXCEPTION_HANDLER").otherwise("EXCEPTION_HANDLER")
    return _found(_has(text, "ExceptionHandler"), kind, F.coalesce(path, F.lit("")))


def jaxrs(text: Column, class_text: Column, method_text: Column) -> Column:
    """A JAX-RS verb with the paths of class and method."""
    verb = F.coalesce(*[F.when(_is(text, v), F.lit(v)) for v in JAXRS_VERBS])
    path = lambda notes: _first_string(arguments(F.coalesce(notes, F.lit("")), "Path"))
    return _found(verb.isNotNull(), verb, merge_paths(path(class_text), path(method_text)))


def kafka(text: Column) -> Column:
    """A listener's topics: named, else positional, else a pattern."""
    given = arguments(text, "KafkaListener")
    topics, place, pattern = attribute(given, "topics"), positional(given), attribute(given, "topicPattern")
    names = F.when(topics != "", items(topics)).when(place != "", items(place)).otherwise(F.transform(items(pattern), lambda p: F.concat(F.lit("PATTERN:"), p)))
    return _consumers(_has(text, "KafkaListener"), "KAFKA_CONSUMER", names)


def rabbit(text: Column) -> Column:
    """A listener's queues."""
    return _consumers(_has(text, "RabbitListener"), "RABBIT_CONSUMER", items(attribute(arguments(text, "RabbitListener"), "queues")))


def spring_event(text: Column, params: Column) -> Column:
    """A listener's event classes; without any, the simple type of its first parameter."""
    classes = items(attribute(arguments(text, "EventListener"), "classes"))
    first = F.substring_index(F.regexp_extract(F.coalesce(params, F.lit("")), r"^\s*\(\s*(?:final\s+)?([\w.$]+)[^,)]*\s\w+", 1), ".", -1)
    return _consumers(_has(text, "EventListener"), "SPRING_EVENT_CONSUMER", F.when(F.size(classes) > 0, classes).otherwise(F.filter(F.array(first), lambda n: n != "")))


#: Extractors by name, each from (text, class_text, method_text, return_type, params); further ones may be added.
EXTRACTORS: dict[str, Callable[..., Column]] = {
    "spring": lambda t, c, m, r, p: F.concat(spring_mapping(t, c, m, r), spring_exception_handler(t, c)),
    "jaxrs": lambda t, c, m, r, p: jaxrs(t, c, m),
    "kafka": lambda t, c, m, r, p: kafka(t),
    "rabbit": lambda t, c, m, r, p: rabbit(t),
    "event": lambda t, c, m, r, p: spring_event(t, p),
}


def endpoints(text: Column, class_text: Column, method_text: Column, return_type: Column, params: Column, extractors: dict[str, Callable[..., Column]] | None = None) -> Column:
    """All endpoints that the extractors find in an annotation's text, as a bag."""
    return F.concat(*[f(text, class_text, method_text, return_type, params) for f in (extractors or EXTRACTORS).values()])
