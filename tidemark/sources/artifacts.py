"""Find evidence files in a listing and give them evidence-relative names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.textcols import any_of, label

# Fixed values: (artifact type, path below the volume root, whole directory).
PATTERNS: list[tuple[str, str, bool]] = [
    ("MFT", "$MFT", False),
    ("USNJRNL", "$Extend/$UsnJrnl:$J", False),
    ("USNJRNL", "$Extend/$J", False),
    ("LOGFILE", "$LogFile", False),
    ("EVTX", "Windows/System32/winevt/Logs/*.evtx", False),
    ("PREFETCH", "Windows/Prefetch/", True),
    ("SRUM", "Windows/System32/sru/SRUDB.dat", False),
    ("AMCACHE", "Windows/AppCompat/Programs/Amcache.hve", False),
    ("PCASVC", "Windows/appcompat/pca/PcaAppLaunchDic.txt", False),
    ("PCASVC", "Windows/appcompat/pca/PcaGeneralDb0.txt", False),
    ("PCASVC", "Windows/appcompat/pca/PcaGeneralDb1.txt", False),
    ("LNK", "Users/*/AppData/Roaming/Microsoft/Windows/Recent/", True),
    ("TASK", "Windows/System32/Tasks/", True),
    ("BROWSER", "Users/*/AppData/Local/Google/Chrome/User Data/*/History", False),
    ("BROWSER", "Users/*/AppData/Local/Microsoft/Edge/User Data/*/History", False),
    ("BROWSER", "Users/*/AppData/Roaming/Mozilla/Firefox/Profiles/*/places.sqlite", False),
    ("WINTIMELINE", "Users/*/AppData/Local/ConnectedDevicesPlatform/*/ActivitiesCache.db", False),
    ("RECYCLEBIN", "$Recycle.Bin/", True),
    ("WER", "Users/*/AppData/Local/Microsoft/Windows/WER/ReportArchive/*/*.wer", False),
    ("WER", "ProgramData/Microsoft/Windows/WER/ReportArchive/*/*.wer", False),
    ("PSHISTORY", "Users/*/AppData/Roaming/Microsoft/Windows/PowerShell/PSReadLine/ConsoleHost_history.txt", False),
    ("SHELLBAG", "Users/*/AppData/Local/Microsoft/Windows/UsrClass.dat", False),
    ("SHELLBAG", "Users/*/NTUSER.DAT", False),
    ("REGISTRY", "Windows/System32/config/SYSTEM", False),
    ("REGISTRY", "Windows/System32/config/SOFTWARE", False),
    ("REGISTRY", "Windows/System32/config/SAM", False),
    ("REGISTRY", "Windows/System32/config/SECURITY", False),
    ("REGISTRY", "Users/*/NTUSER.DAT", False),
    ("REGISTRY", "Users/*/AppData/Local/Microsoft/Windows/UsrClass.dat", False),
]

# Fixed values: (artifact type, path in an extracted evidence folder, whole directory); ``**`` is any depth.
EXTRACTED_PATTERNS: list[tuple[str, str, bool]] = [
    ("MFT", "MFT", False),
    ("LOGFILE", "LogFile", False),
    ("USNJRNL", "UsnJrnl_J", False),
    ("EVTX", "evtx/*.evtx", False),
    ("PREFETCH", "Prefetch/", True),
    ("REGISTRY", "SYSTEM", False),
    ("REGISTRY", "SOFTWARE", False),
    ("REGISTRY", "SAM", False),
    ("REGISTRY", "SECURITY", False),
    ("SRUM", "sru/SRUDB.dat", False),
    ("AMCACHE", "Amcache.hve", False),
    ("PCASVC", "PcaAppLaunchDic.txt", False),
    ("PCASVC", "PcaGeneralDb0.txt", False),
    ("PCASVC", "PcaGeneralDb1.txt", False),
    ("LNK", "Recent/", True),
    ("TASK", "Tasks/", True),
    ("RECYCLEBIN", "RecycleBin/", True),
    ("REGISTRY", "userhives/*/NTUSER.DAT", False),
    ("SHELLBAG", "userhives/*/NTUSER.DAT", False),
    ("REGISTRY", "userhives/*/UsrClass.dat", False),
    ("SHELLBAG", "userhives/*/UsrClass.dat", False),
    ("BROWSER", "browser/*/*", False),
    ("WINTIMELINE", "wintimeline/*/ActivitiesCache.db", False),
    ("WER", "wer/**.wer", False),
    ("WER", "wer_system/**.wer", False),
    ("PSHISTORY", "pshistory/*/ConsoleHost_history.txt", False),
]

_KEYS = ["host_id", "image_id"]


def list_files(spark: SparkSession, root: str, image_id: str, host_id: str | None = None) -> DataFrame:
    """Recursive listing below ``root`` with paths relative to it (file content is never read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length", F.col("modificationTime").alias("modification_time")))
    return files.select(
        F.lit(host_id or image_id).alias("host_id"), F.lit(image_id).alias("image_id"),
        below("path", root).alias("path"), "length", "modification_time")


def _pattern_regex(pattern: str, is_dir: bool) -> str:
    body = ".*".join("[^/]*".join(re.escape(part) for part in deep.split("*"))
                     for deep in pattern.lower().rstrip("/").split("**"))
    return f"^{body}/." if is_dir else f"^{body}$"


def _matches(low: Column, pattern: str, is_dir: bool) -> Column:
    """Cheap fixed-text tests first; the regular expression runs only where they hold."""
    pattern = pattern.lower()
    head, *more = pattern.split("*")
    if not more:
        return low.startswith(pattern) & (F.length(low) > len(pattern)) if is_dir else low == pattern
    fits = low.startswith(head) if is_dir else low.startswith(head) & low.endswith(more[-1])
    return fits & low.rlike(_pattern_regex(pattern, is_dir))


def classify_artifacts(files: DataFrame, patterns=PATTERNS) -> DataFrame:
    """Match every path against the rules; a file may serve several artifact types.

    The rules are literal tests evaluated in the row: no join with the rule table.  Directory
    rules add up the size of everything below the directory.
    """
    listed = files.select(*_KEYS, "length", F.translate("path", "\\", "/").alias("path"))
    listed = listed.withColumn("_low", F.lower("path"))
    hits = []
    for kind, pattern, is_dir in patterns:
        levels = pattern.rstrip("/").count("/") + 1
        found = F.substring_index("path", "/", levels) if is_dir else F.col("path")
        hits.append(F.when(_matches(F.col("_low"), pattern, is_dir), F.struct(
            F.lit(kind).alias("artifact_type"), found.alias("path"), F.lit(is_dir).alias("is_directory"))))
    matched = listed.select(*_KEYS, "length", F.inline(F.array(*hits))).filter("artifact_type IS NOT NULL")
    return matched.groupBy(*_KEYS, "artifact_type", "path", "is_directory").agg(F.sum("length").alias("size_bytes"))


def belongs(path: Column, kind: str) -> Column:
    """Whether a relative path lies in one of the places of an artifact type, on a volume or in an extracted folder."""
    low = F.lower(F.translate(path, "\\", "/"))
    return any_of([_matches(low, pattern, is_dir) for k, pattern, is_dir in PATTERNS + EXTRACTED_PATTERNS if k == kind])


def below(path, root: str) -> Column:
    """Path relative to ``root``, whatever scheme the listing puts before it."""
    bare = re.sub(r"^[a-z0-9]+:/*", "/", root.rstrip("/")) + "/"
    return F.substring_index(path, bare, -1)


def classify_extracted(files: DataFrame) -> DataFrame:
    """Jobs of an extracted evidence folder, with their place on the volume as ``logical_path``."""
    return logical_path(classify_artifacts(files, EXTRACTED_PATTERNS))


def dedupe_artifacts(jobs: DataFrame) -> DataFrame:
    """One job per (type, path), largest first."""
    return jobs.groupBy(*_KEYS, "artifact_type", "path", "is_directory").agg(
        F.max("size_bytes").alias("size_bytes")).orderBy(F.desc("size_bytes"), "artifact_type", "path")


# Flat names of an extracted evidence folder and their place on the volume.
FLAT_NAMES = {
    "MFT": "$MFT",
    "LogFile": "$LogFile",
    "UsnJrnl_J": "$Extend\\$UsnJrnl:$J",
    "UsnJrnl_Max": "$Extend\\$UsnJrnl:$Max",
    "SYSTEM": "Windows\\System32\\config\\SYSTEM",
    "SOFTWARE": "Windows\\System32\\config\\SOFTWARE",
    "SAM": "Windows\\System32\\config\\SAM",
    "SECURITY": "Windows\\System32\\config\\SECURITY",
    "sru/SRUDB.dat": "Windows\\System32\\sru\\SRUDB.dat",
    "Amcache.hve": "Windows\\AppCompat\\Programs\\Amcache.hve",
    "Prefetch": "Windows\\Prefetch",
    "Recent": "Users\\*\\AppData\\Roaming\\Microsoft\\Windows\\Recent",
}
# Per-user and per-log folders of an extracted evidence folder.
FLAT_FOLDERS = [
    ("^evtx/([^/]+)$", "Windows\\System32\\winevt\\Logs\\$1"),
    ("^userhives/([^/]+)/([^/]+)$", "Users\\$1\\$2"),
    ("^browser/([^/]+)/([^/]+)$", "Users\\$1\\AppData\\Local\\$2"),
    ("^wintimeline/([^/]+)/[^/]+$", "Users\\$1\\AppData\\Local\\ConnectedDevicesPlatform\\*\\ActivitiesCache.db"),
    ("^pshistory/([^/]+)/[^/]+$", "Users\\$1\\AppData\\Roaming\\Microsoft\\Windows\\PowerShell\\PSReadLine"
                                  "\\ConsoleHost_history.txt"),
    ("^wer(?:_system)?/(.+)$", "$1"),
]


def logical_path_of(path) -> Column:
    """Evidence-relative Windows path of a file in a mounted volume or an extracted folder."""
    path = F.translate(path if isinstance(path, Column) else F.col(path), "\\", "/")
    out = label(path, FLAT_NAMES, F.replace(path, F.lit("/"), F.lit("\\")))
    for regex, target in reversed(FLAT_FOLDERS):
        replaced = F.regexp_replace(path, regex, target.replace("\\", "\\\\"))
        out = F.when(path.rlike(regex), F.replace(replaced, F.lit("/"), F.lit("\\"))).otherwise(out)
    return out


def logical_path(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("logical_path", logical_path_of("path"))
