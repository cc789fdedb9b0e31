"""Frame-evidence analytics as Spark jobs.

Tables of video frames (recognised text lines, measured image metrics and
feature vectors) go in; classified, de-duplicated, reviewed and summarised
tables come out.  Every operator takes and returns DataFrames or Columns.
"""

__version__ = "0.1.0"
