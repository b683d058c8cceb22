from tableprep.sources.files import Dataset, preview, read_csv, read_text_lines, rename_first_to_text, route
from tableprep.sources.tables import TABLES, VIEW_SQL, read_table, register_tables, view

__all__ = ["Dataset", "preview", "read_csv", "read_text_lines", "rename_first_to_text", "route", "TABLES",
           "VIEW_SQL", "read_table", "register_tables", "view"]
