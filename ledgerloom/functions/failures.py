"""Failure codes: what went wrong, what to tell, whether trying again can help."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, stage, message, retryable.
CODES = (
    ("PDF_CORRUPTED", "PDF Validation", "PDF file is corrupted or cannot be read.", False),
    ("PDF_INVALID", "PDF Validation", "The file is not a valid PDF.", False),
    ("PDF_ENCRYPTED", "PDF Validation", "PDF is password protected and cannot be opened.", False),
    ("PDF_EMPTY", "PDF Validation", "PDF is empty - it contains no pages.", False),
    ("PDF_INCOMPLETE", "PDF Validation", "PDF is incomplete or truncated - the copy did not finish.", False),
    ("WATERMARK_REMOVAL_FAILED", "Watermark Removal", "Watermark was not removed.", True),
    ("OCR_FAILED", "OCR", "OCR was not completed.", True),
    ("OCR_NO_TEXT", "OCR", "OCR completed but no readable text was extracted.", True),
    ("OCR_INSUFFICIENT_TEXT", "OCR", "OCR found too little text to be a readable deed - the pages are probably scans that need a real OCR pass.", True),
    ("OCR_TIMEOUT", "OCR", "OCR took too long and was stopped.", True),
    ("AI_SERVER_UNAVAILABLE", "AI Extraction", "The AI server is not reachable.", True),
    ("AI_INPUT_TOO_LARGE", "AI Extraction", "The deed is too long for the model to read in one pass.", True),
    ("AI_EXTRACTION_FAILED", "AI Extraction", "The AI returned no usable data for this deed.", True),
    ("AI_PROCESSING_FAILED", "AI Extraction", "AI processing failed for this deed.", True),
    ("TRANSLATION_FAILED", "Translation", "Translation of the extracted values failed.", True),
    ("DATABASE_ERROR", "Database Save", "The result could not be saved to the database.", True),
    ("FILE_ACCESS_ERROR", "File Access", "The file could not be read from disk.", True),
    ("MEMORY_ERROR", "Resources", "The machine ran out of memory or GPU memory.", True),
    ("TIMEOUT", "Processing", "Processing timed out.", True),
    ("UNKNOWN_ERROR", "Processing", "Processing failed for an unrecognised reason.", True),
)
# Patterns in the order in which they are tried.
PATTERNS = (
    (r"exceeds the available context size|n_ctx|too many tokens", "AI_INPUT_TOO_LARGE"),
    (r"could not be made because the target machine actively refused|EngineNotReadyError|connection refused|URLError|llama-server (exited|did not)|AI server (unreachable|is still loading|is up but not admitting|refused work|did not finish the job)|AI server HTTP 5\d\d",
        "AI_SERVER_UNAVAILABLE"),
    (r"no parseable JSON|no usable JSON|unparseable|empty response", "AI_EXTRACTION_FAILED"),
    (r"out of memory|CUDA out of memory|OutOfMemoryError|MemoryError", "MEMORY_ERROR"),
    (r"timed out|TimeoutExpired|timeout", "TIMEOUT"),
    (r"password|encrypted", "PDF_ENCRYPTED"),
    (r"incomplete|truncated", "PDF_INCOMPLETE"),
    (r"corrupt|structure is invalid|cannot be opened|PdfiumError|FileDataError", "PDF_CORRUPTED"),
    (r"not a valid PDF|does not begin with a PDF header|invalid header", "PDF_INVALID"),
    (r"empty \(0 bytes\)|contains no pages|zero pages|EmptyFileError|cannot open empty file", "PDF_EMPTY"),
    (r"no usable text|produced no text|no text layer", "OCR_NO_TEXT"),
    (r"only \d+ characters across|pure scan|insufficient text", "OCR_INSUFFICIENT_TEXT"),
    (r"watermark", "WATERMARK_REMOVAL_FAILED"),
    (r"OCR", "OCR_FAILED"),
    (r"translat", "TRANSLATION_FAILED"),
    (r"IntegrityError|OperationalError|database|psycopg", "DATABASE_ERROR"),
    (r"PermissionError|FileNotFoundError|OSError|could not read", "FILE_ACCESS_ERROR"),
)
# The code of a verdict on a file, and of a stage that failed without saying why.
VERDICTS = {
    "CORRUPTED_PDF": "PDF_CORRUPTED", "INVALID_PDF": "PDF_INVALID", "PASSWORD_PROTECTED": "PDF_ENCRYPTED", "EMPTY_PDF": "PDF_EMPTY",
    "INCOMPLETE_PDF": "PDF_INCOMPLETE", "UNREADABLE_PDF": "FILE_ACCESS_ERROR", "PDF_PARSE_ERROR": "PDF_CORRUPTED", "PDF_RENDER_ERROR": "PDF_CORRUPTED",
}
STAGE_CODES = {"ocr": "OCR_FAILED", "extract": "AI_PROCESSING_FAILED", "translate": "TRANSLATION_FAILED", "validate": "AI_EXTRACTION_FAILED"}
# Fixed value: what counts as a path in a text; codes are read from texts without paths, so it decides codes too.
PATHS = r"""'[^']*[/\\][^']*'|"[^"]*[/\\][^"]*"|\b[A-Za-z]:\\[^\s,;)]*|(?<![\w'"])/[^\s,;)]{3,}"""


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def strip_paths(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), PATHS, "<file>"))


def sanitise(text: Column) -> Column:
    """Up to a stack trace, white space collapsed, at most 400 characters."""
    head = F.substring_index(F.coalesce(text, F.lit("")), "Traceback", 1)
    return F.left(F.trim(F.regexp_replace(head, r"(?U)\s+", " ")), F.lit(400))


def code_of_text(text: Column) -> Column:
    """The first pattern that the text without its paths has, or null."""
    bare, out = strip_paths(text), None
    for pattern, code in PATTERNS:
        hit = bare.rlike(f"(?i){pattern}")
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def failed_stage(ocr: Column, extract: Column, translate: Column, validate: Column) -> Column:
    """The first failed stage in the order of the columns, or an empty string."""
    named = zip((ocr, extract, translate, validate), ("ocr", "extract", "translate", "validate"), strict=True)
    return F.coalesce(*[F.when(c == "failed", name) for c, name in named], F.lit(""))


def code(text: Column, verdict: Column, stage: Column | None = None) -> Column:
    """The verdict on the file, else what the text says, else the stage, else unknown."""
    found = [F.try_element_at(_map(VERDICTS), verdict), code_of_text(text)]
    return F.coalesce(*found, *([F.try_element_at(_map(STAGE_CODES), stage)] if stage is not None else []), F.lit("UNKNOWN_ERROR"))


def messages(spark: SparkSession) -> DataFrame:
    """The twenty codes; fixed in size, so it may be broadcast."""
    return spark.createDataFrame(CODES, "code string, code_stage string, message string, retryable boolean")


def explain(failures: DataFrame, spark: SparkSession) -> DataFrame:
    """failures: technical, validation_status, stage. Adds code, code_stage, message, retryable, detail."""
    coded = failures.withColumn("code", code(F.col("technical"), F.col("validation_status"), F.col("stage"))).withColumn("detail", sanitise(F.col("technical")))
    return coded.join(F.broadcast(messages(spark)), "code", "left")
