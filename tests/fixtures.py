"""Small chunk sets for import queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.schema import CHUNK


def _method(full_name: str, ast_hash: str, calls=(), used=(), annotations=(), handles=None, implemented=()) -> dict:
    return {"name": full_name, "full_name": full_name, "body": f"void {full_name}() {{}}", "ast_hash": ast_hash, "method_calls": [{"name": c, "params": []} for c in calls], "used_types": list(used), "field_access": [], "inheritance_info": list(implemented), "endpoint": [], "type": "regular", "project_id": "1", "branch": "develop", "handles_annotation": handles, "annotations": list(annotations)}


def _chunk(name: str, ast_hash: str, methods=(), used=(), implements=(), annotations=(), handles=None, branch: str = "develop", is_annotation: bool = False) -> dict:
    return {"package": "p", "class_name": name, "full_class_name": f"p.{name}", "file_path": f"/src/p/{name}.java", "content": f"class {name}", "ast_hash": ast_hash, "implements": list(implements), "methods": list(methods), "parent_class": None, "project_id": "1", "branch": branch, "used_types": list(used), "is_nested": False, "type": "regular", "is_annotation": is_annotation, "handles_annotation": handles, "annotations": list(annotations)}


FIRST = [
    _chunk("ClassA", "a1", [_method("methodA", "ma1", calls=["methodB"])]),
    _chunk("ClassB", "b1", [_method("methodB", "mb1", used=["p.ClassC"])]),
    _chunk("ClassC", "c1"),
]
SECOND = [_chunk("ClassB", "b2", [_method("methodB", "mb2", used=["p.ClassC"])])]
ANNOTATED = [
    _chunk("Validation", "v1", is_annotation=True, branch="main"),
    _chunk("NotNull", "n1", is_annotation=True, branch="main"),
    _chunk("ValidationHandler", "h1", [_method("isValid", "iv1", handles="p.Validation")], handles="p.Validation", branch="main"),
    _chunk("UserService", "u1", [_method("createUser", "cu1", annotations=["p.Validation"])], annotations=["p.Validation", "p.NotNull"], implements=["p.ValidationHandler"], branch="main"),
]


def chunks(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Chunk rows as a DataFrame."""
    return spark.createDataFrame(rows, CHUNK)


#: One row per kind of annotation: key, annotation, class's annotations, method's annotations, return type, parameters.
ANNOTATIONS = [
    ("get", '@GetMapping("/a/{id}")', '@RestController @RequestMapping("/api/")', '@GetMapping("/a/{id}")', "User", "(int id)"),
    ("request", '@RequestMapping(value = "/r", method = RequestMethod.PUT)', "@RestController", "", "Mono<User>", "()"),
    ("hidden", '@PostMapping("/x")', "@Controller", "", "String", "()"),
    ("body", '@PostMapping("/x")', "@Controller", "@ResponseBody", "String", "()"),
    ("handler", "@ExceptionHandler({AError.class, BError.class})", "@RestControllerAdvice", "", "void", "()"),
    ("handler1", "@ExceptionHandler(AError.class)", "@ControllerAdvice", "", "void", "()"),
    ("jax", "@GET", '@Path("/users/")', '@GET @Path("/{id}")', "User", "()"),
    ("kafka", '@KafkaListener(topics = {"t1", "t2"})', "", "", "void", "()"),
    ("kafka1", '@KafkaListener(topics = "t3")', "", "", "void", "()"),
    ("kafkap", '@KafkaListener(topicPattern = "t.*")', "", "", "void", "()"),
    ("kafka0", '@KafkaListener("t4")', "", "", "void", "()"),
    ("rabbit", '@RabbitListener(queues = {"q1","q2"})', "", "", "void", "()"),
    ("rabbit1", '@RabbitListener(queues = "q3")', "", "", "void", "()"),
    ("event", "@EventListener(classes = {A.class, B.class})", "", "", "void", "()"),
    ("event1", "@EventListener", "", "", "void", "(x.y.Made event)"),
    ("none", "@Override", "", "", "void", "()"),
]


def annotations(spark: SparkSession) -> DataFrame:
    """The annotation rows as a DataFrame."""
    return spark.createDataFrame(ANNOTATIONS, "key string, text string, class_text string, method_text string, return_type string, params string")
