"""Sources and plug-ins that bring files, text, vectors and captions in."""
