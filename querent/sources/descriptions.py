"""Database descriptions: looked up by id, as rows and as prompt text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from querent.sources.files import exists, read_json

#: The Vietnamese wording of descriptions in prompts.
POLICY = (
    "Quy ước mô tả:",
    "- Mọi cột trong schema đều có mô tả; cột rõ nghĩa được mô tả ngắn.",
    "- Cột khóa ngoại, cờ/mã, tên viết tắt, typo, hoặc kiểu dữ liệu dễ nhầm được giải thích rõ hơn.",
    "",
)

ROWS_DDL = "db_id string, table_pos int, table string, description string, col_pos int, column string, col_description string"


def _internal(table: str) -> bool:
    return table.strip().lower().startswith("sqlite_")


def render(data: dict) -> str:
    """The text of one description; what is missing leaves no line."""
    if not data:
        return ""
    out: list[str] = []
    if about := data.get("db_description"):
        out += ["Database description:", f"Mô tả database: {about}", "", *POLICY]
    for name, info in data.get("tables", {}).items():
        if _internal(name):
            continue
        kind = info.get("type")
        out.append(f"Bảng: {name}" + (f" [{kind}]" if kind else ""))
        if info.get("description"):
            out.append(f"  Mô tả: {info['description']}")
        for title, values, show in (("Mô tả cột", info.get("columns"), str), ("Giá trị mẫu", info.get("sample_values"), lambda v: json.dumps(v, ensure_ascii=False))):
            if values:
                out += [f"  {title}:", *(f"    - {c}: {show(v)}" for c, v in values.items())]
        out.append("")
    for title, rows in (("Quan hệ", data.get("relationships")), ("Gợi ý join", data.get("join_hints"))):
        if rows:
            out += [f"{title}:", *(f"  - {r}" for r in rows)]
    return "\n".join(out).strip()


class Descriptions:
    """``<folder>/<db_id>.json`` before the aggregate file, where case does not count."""

    def __init__(self, spark: SparkSession, folder: str, file: str | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.file = f"{self.folder}/description_db.json" if file is None else file if "/" in file else f"{self.folder}/{file}"
        self._all: dict | None = None
        self._known: dict[str, dict] = {}

    def aggregate(self) -> dict:
        if self._all is None:
            self._all = read_json(self.spark, self.file) if exists(self.spark, self.file) else {}
        return self._all

    def load(self, db_id: str) -> dict:
        if db_id not in self._known:
            own = f"{self.folder}/{db_id}.json"
            if exists(self.spark, own):
                found = read_json(self.spark, own)
            else:
                every = self.aggregate()
                found = every[db_id] if db_id in every else next((v for k, v in every.items() if k.lower() == db_id.lower()), {})
            self._known[db_id] = found
        return self._known[db_id]

    def text(self, db_id: str) -> str:
        return render(self.load(db_id))

    def texts(self, db_ids: list[str]) -> DataFrame:
        """(db_id, description_text) of the given databases."""
        return self.spark.createDataFrame([(d, self.text(d)) for d in db_ids], "db_id string, description_text string")

    def rows(self, db_ids: list[str]) -> DataFrame:
        """One row for each described column, in file order; see ``rich_targets``."""
        out = []
        for db in db_ids:
            for i, (table, info) in enumerate(self.load(db).get("tables", {}).items()):
                columns = list(info.get("columns", {}).items()) or [(None, None)]
                out += [(db, i, table, info.get("description", ""), j, c, d) for j, (c, d) in enumerate(columns)]
        return self.spark.createDataFrame(out, ROWS_DDL)
