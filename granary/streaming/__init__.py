"""The same operators over folders that fill up."""
