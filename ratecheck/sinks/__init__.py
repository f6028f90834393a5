"""Writers: CSV / JSON / text exports."""
