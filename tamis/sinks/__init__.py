"""Writers: record exports and report files, as ordered part files."""
