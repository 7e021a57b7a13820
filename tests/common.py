def normal(frame):
    """A pandas frame with sorted columns and rows, numbers rounded, nulls alike."""
    cols = sorted(frame.columns)
    out = frame[cols].apply(lambda s: s.astype(float).round(6).astype(str) if s.dtype.kind in "fiu" else s.astype(str).replace({"None": "nan", "<NA>": "nan"}))
    return out.sort_values(cols).reset_index(drop=True)
